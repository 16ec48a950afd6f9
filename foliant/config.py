"""Settings: immutable, read from a mapping such as the environment, clamped to their bounds."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

TRUE = ("1", "true", "yes", "on")
UNITS = {"GB": 1 << 30, "MB": 1 << 20, "KB": 1 << 10, "B": 1}
DEFAULT_TYPES = ("pdf", "docx", "pptx", "xlsx", "html", "htm", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def parse_bool(text: str | None, default: bool = False) -> bool:
    return default if text is None else text.strip().lower() in TRUE


def parse_size(text: str | None, default: int) -> int:
    t = (text or "").strip().upper()
    if not t:
        return default
    unit = next((u for u in UNITS if t.endswith(u)), "")
    return int(float(t.removesuffix(unit)) * UNITS[unit]) if unit else int(t)


def parse_types(text: str | None, default: tuple[str, ...] = DEFAULT_TYPES) -> tuple[str, ...]:
    found = dict.fromkeys(x.strip().lower().lstrip(".") for x in (text or "").split(","))
    return tuple(x for x in found if x) or default


def database_kind(text: str | None) -> str:
    """sqlite or mysql; sqlite where nothing is given."""
    kind = (text or "sqlite").strip().lower()
    if kind not in ("sqlite", "mysql"):
        raise ValueError(f"DB_TYPE {text!r}: sqlite or mysql")
    return kind


def clamp(value: float, low: float, high: float) -> float:
    return max(low, min(value, high))


def first_given(*values: object) -> object:
    """An explicit option, else the environment's, else the default."""
    return next((v for v in values if v is not None), None)


@dataclass(frozen=True)
class Settings:
    max_file_size: int = 20 << 20
    allowed_types: tuple[str, ...] = DEFAULT_TYPES
    max_parallel_jobs: int = 1
    page_workers: int = 10
    page_dpi: int = 180
    max_pages: int | None = None
    max_files: int = 0
    low_memory: bool = False
    scan_mode: bool = False
    ocr_quality: str = "balanced"
    table_structure: bool = True
    table_accurate: bool = True
    page_images: bool = False
    llm_max_tokens: int = 16384
    llm_timeout: float = 300.0
    llm_retries: int = 3
    llm_backoff: float = 1.5
    llm_empty_attempts: int = 3
    llm_thinking: bool = False
    llm_max_reasoning_tokens: int | None = None
    context_lines: int = 2
    max_captions: int = 0

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        number = lambda key, default: int(env[key]) if env.get(key, "").strip() else default
        size = parse_size(env.get("MAX_FILE_SIZE"), cls.max_file_size)
        pages = number("PDF_VL_MAX_PAGES", 0)
        return cls(
            max_file_size=size,
            allowed_types=parse_types(env.get("ALLOWED_FILE_TYPES")),
            max_parallel_jobs=max(1, number("WORKER_MAX_PARALLEL_JOBS", 1)),
            page_workers=int(clamp(number("PDF_VL_WORKERS", 10), 1, 64)),
            page_dpi=int(clamp(number("PDF_VL_DPI", 180), 72, 600)),
            max_pages=pages or None,
            low_memory=parse_bool(env.get("LOW_MEMORY")),
            scan_mode=parse_bool(env.get("SCAN_PDF_MODE")),
            ocr_quality=env.get("OCR_QUALITY", "balanced").strip().lower(),
            llm_max_tokens=max(1, number("LLM_MAX_TOKENS", 16384)),
            llm_timeout=max(30.0, float(env.get("LLM_TIMEOUT_SEC") or 300)),
            llm_retries=max(1, number("LLM_MAX_RETRIES", 3)),
            llm_backoff=float(env.get("LLM_RETRY_BACKOFF_SEC") or 1.5),
            llm_empty_attempts=int(clamp(number("LLM_EMPTY_CONTENT_MAX_ATTEMPTS", 3), 1, 10)),
            llm_thinking=parse_bool(env.get("LLM_ENABLE_THINKING")),
        )

    @property
    def effective_ocr_quality(self) -> str:
        return "fast" if self.low_memory else self.ocr_quality if self.ocr_quality in ("fast", "balanced", "high") else "balanced"

    @property
    def layout_options(self) -> dict[str, float]:
        """Scale cap, recognition threshold and batch size that follow from quality and memory."""
        scale, threshold = {"fast": (0.25, 0.52), "balanced": (0.55, 0.38), "high": (1.0, 0.30)}[self.effective_ocr_quality]
        if self.scan_mode:
            scale, threshold = min(scale, 0.55), min(threshold, 0.32)
        return {"images_scale": scale, "threshold": threshold, "page_batch": 1 if self.low_memory or self.scan_mode else 4}

    def rerun(self, ocr_quality: str, table_accuracy: str, page_images: bool) -> Settings:
        """What a quality check's suggestion makes of these settings; memory limits stay in force."""
        pages = self.page_images or (page_images and not self.low_memory and not self.scan_mode)
        accurate = table_accuracy == "accurate" if self.table_structure else self.table_accurate
        return replace(self, ocr_quality=ocr_quality, table_accurate=accurate, page_images=pages)
