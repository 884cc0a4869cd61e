"""PDF text and OCR behind engines that can be put in, with one ladder of statuses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

LEAST_NATIVE, LEAST_CONFIDENCE, DPI, LANGUAGES = 80, 0.75, 300, "lao+eng"  # fixed values


@dataclass
class Page:
    page_num: int
    text: str
    items: list[dict] = field(default_factory=list)
    confidence: float | None = None


@dataclass
class Outcome:
    status: str
    pages: list[Page]
    confidence: float | None = None
    error: str | None = None

    @property
    def text(self) -> str:
        return "\n\n".join(p.text.strip() for p in self.pages if p.text.strip())


Engine = Callable[[bytes], list[Page]]


def _weight(pages: list[Page]) -> tuple[int, int]:
    return sum(len("".join(p.text.split())) for p in pages), sum(len(p.items) for p in pages)


def native_text(data: bytes, engines: list[Engine]) -> list[Page]:
    """Of all engines that can read the file the pages with most characters; boxes break ties."""
    tried = []
    for e in engines:
        try:
            tried.append(e(data))
        except Exception:  # an engine may fail on any file in its own way; the others go on
            continue
    return max(tried, key=_weight, default=[])


def read_pages(data: bytes, native: list[Engine], ocr: Engine | None = None, threshold: float = LEAST_CONFIDENCE) -> Outcome:
    """native_text, native_text_insufficient with no engine: ocr_unavailable, ocr_error, ocr_review_required or ocr_complete."""
    pages = native_text(data, native)
    if _weight(pages)[0] >= LEAST_NATIVE:
        return Outcome("native_text", pages)
    if ocr is None:
        return Outcome("ocr_unavailable" if not pages else "native_text_insufficient", pages)
    try:
        read = ocr(data)
    except Exception as e:  # reported, not hidden
        return Outcome("ocr_error", pages, None, f"{type(e).__name__}: {e}")
    known = [c for c in (normal_confidence(p.confidence) for p in read) if c is not None]
    mean = sum(known) / len(known) if known else None
    good = mean is not None and mean >= threshold and bool(_weight(read)[0])
    return Outcome("ocr_complete" if good else "ocr_review_required", read, mean)


def normal_confidence(value) -> float | None:
    try:
        x = float(value)
    except (TypeError, ValueError):
        return None
    return max(0.0, min(1.0, x / 100 if 1 < x <= 100 else x))
