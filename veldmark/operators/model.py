"""What a reader makes of one document."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Asset:
    id: str
    file_name: str
    media_type: str
    data: bytes


@dataclass
class Document:
    """Blocks as `veldmark.operators.emit` takes them, and what belongs to them. Warnings are (code, message, page)."""

    blocks: list
    source_format: str
    title: str | None = None
    author: str | None = None
    subject: str | None = None
    page_count: int | None = None
    properties: dict[str, str] = field(default_factory=dict)
    assets: list[Asset] = field(default_factory=list)
    warnings: list[tuple[str, str, int | None]] = field(default_factory=list)

    def warn(self, code: str, message: str, page: int | None = None, once: bool = False) -> None:
        """``once``: not again for the same code and page."""
        if not (once and any((c, p) == (code, page) for c, _, p in self.warnings)):
            self.warnings.append((code, message, page))
