"""Accounts: password digests, signed tokens, answers of an external login. Users are rows, added but never changed in place."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import secrets
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 210_000


def password_digest(password: str, salt: bytes | None = None) -> str:
    salt = secrets.token_bytes(16) if salt is None else salt
    return f"pbkdf2_sha256${ROUNDS}${salt.hex()}${hashlib.pbkdf2_hmac('sha256', password.encode(), salt, ROUNDS).hex()}"


def password_fits(password: str, digest: str) -> bool:
    kind, rounds, salt, want = (digest.split("$") + [""] * 4)[:4]
    if kind != "pbkdf2_sha256" or not rounds.isdigit():
        return False
    got = hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt), int(rounds)).hex()
    return hmac.compare_digest(got, want)


def _segment(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _signature(text: str, secret: str) -> str:
    return _segment(hmac.new(hashlib.sha256(secret.encode()).digest(), text.encode(), hashlib.sha256).digest())


def token(username: str, role: str, secret: str, seconds: int, now: float | None = None) -> str:
    """An HS256 token; the key is the secret's digest, so that short secrets have full length."""
    began = int(time.time() if now is None else now)
    parts = ({"alg": "HS256", "typ": "JWT"}, {"sub": username, "role": role, "iat": began, "exp": began + seconds})
    text = ".".join(_segment(json.dumps(p, separators=(",", ":")).encode()) for p in parts)
    return f"{text}.{_signature(text, secret)}"


def token_user(text: str, secret: str, now: float | None = None) -> tuple[str, str] | None:
    """(username, role) of a token that is signed and not expired."""
    head, _, signature = text.rpartition(".")
    if not hmac.compare_digest(signature, _signature(head, secret)):
        return None
    body = json.loads(base64.urlsafe_b64decode(head.partition(".")[2] + "=="))
    return (body["sub"], body["role"]) if body["exp"] > (time.time() if now is None else now) else None


def new_users(wanted: DataFrame, users: DataFrame) -> DataFrame:
    """Wanted usernames that no user has yet."""
    return wanted.select("username").distinct().join(users.select("username"), "username", "left_anti")


def login_succeeded(payload: Column) -> Column:
    """Whether an external answer means success: not `success: false`, and a code of 0 or 200, or data where no code is."""
    code, data = F.get_json_object(payload, "$.code"), F.get_json_object(payload, "$.data")
    fine = F.when(code.isNull(), data.isNotNull() & (data != "")).otherwise(code.isin("0", "200", "true"))
    return F.coalesce(F.get_json_object(payload, "$.success") != "false", F.lit(True)) & fine


def username_of(data: Column, fallback: Column) -> Column:
    """The first name that isn't blank, of the user's four fields, then the answer's own, then the fallback."""
    fields = ("$.user.userName", "$.user.username", "$.user.nickName", "$.user.loginName", "$.username")
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(data, f)), F.lit("")) for f in fields], F.trim(fallback))


def is_admin(data: Column, login: Column, admin: str) -> Column:
    """The configured administrator, a user marked as one, or a role that names one."""
    roles = lambda path: F.coalesce(F.from_json(F.get_json_object(data, path), "array<string>"), F.array().cast("array<string>"))
    every = F.concat(*[roles(p) for p in ("$.roles", "$.roleIds", "$.user.roles", "$.user.roleIds")])
    named = F.exists(every, lambda r: F.lower(r).contains("admin") | (r == "1"))
    return (F.lower(F.trim(login)) == admin.strip().lower()) | F.coalesce(F.get_json_object(data, "$.user.admin") == "true", F.lit(False)) | named
