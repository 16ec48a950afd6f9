from pyspark.sql import functions as F

from foliant.operators import accounts


def test_passwords_and_tokens():
    digest = accounts.password_digest("secret", b"salt")
    assert accounts.password_fits("secret", digest) and not accounts.password_fits("other", digest) and not accounts.password_fits("x", "plain")
    token = accounts.token("u", "admin", "k", 60, now=1000)
    assert accounts.token_user(token, "k", now=1059) == ("u", "admin")
    assert accounts.token_user(token, "k", now=1060) is None and accounts.token_user(token, "other", now=1001) is None


def test_login_answers(spark):
    rows = [
        ('{"code":200}', "u", True, "u", False),
        ('{"code":500,"data":"x"}', " u ", False, "u", False),
        ('{"success":false,"code":0}', "u", False, "u", False),
        ('{"data":{"a":1},"user":{"userName":" n "},"roles":["site-Admin"]}', "u", True, "n", True),
        ('{"user":{"admin":true,"userName":""},"username":"m"}', "u", False, "m", True),
        ("{}", "Root", False, "Root", True),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "p string, login string")
    got = df.select(accounts.login_succeeded(F.col("p")), accounts.username_of(F.col("p"), F.col("login")), accounts.is_admin(F.col("p"), F.col("login"), "root")).collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]


def test_new_users(spark):
    wanted, users = spark.createDataFrame([("a",), ("b",), ("b",)], "username string"), spark.createDataFrame([("a",)], "username string")
    assert [r.username for r in accounts.new_users(wanted, users).collect()] == ["b"]
