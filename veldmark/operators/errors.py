"""The error of a document and the budgets that every reader checks."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: The stable codes of a document's error.
CODES = (
    "invalid_request", "io", "unsupported_format", "unsupported_input", "corrupt_input", "encrypted_input", "limit_exceeded",
    "ocr_required", "cancelled", "pdfium_unavailable", "conversion_failed",
)


class FormatError(ValueError):
    """A document that cannot be converted; ``code`` is the stable error code. A budget's error names it with both numbers."""

    def __init__(self, message: str, code: str = "corrupt_input", limit: str | None = None, actual: int | None = None, maximum: int | None = None):
        super().__init__(message)
        self.code, self.limit, self.actual, self.maximum = code, limit, actual, maximum


def within(limit: str, actual: int, maximum: int) -> int:
    """``actual``, unless it is over its budget."""
    if actual > maximum:
        raise FormatError(f"limit {limit} exceeded: actual {actual}, maximum {maximum}", "limit_exceeded", limit, actual, maximum)
    return actual


@dataclass(frozen=True)
class Limits:
    """The budgets of one document. None may be 0, and a tree is never deeper than 128."""

    input_bytes: int = 500 << 20
    pages: int = 2_000
    assets: int = 10_000
    csv_records: int = 10_000
    csv_fields_per_record: int = 4_096
    csv_cells: int = 100_000
    csv_field_bytes: int = 64 << 10
    json_nodes: int = 50_000
    json_object_entries: int = 10_000
    json_array_entries: int = 20_000
    json_nesting_depth: int = 128
    xml_nodes: int = 10_000
    xml_attributes_per_element: int = 4_096
    xml_attributes: int = 100_000
    xml_text_bytes: int = 1 << 20
    xml_nesting_depth: int = 128
    html_dom_depth: int = 256
    html_dom_nodes: int = 1_000_000
    archive_entries: int = 10_000
    archive_entry_compressed_bytes: int = 128 << 20
    archive_entry_uncompressed_bytes: int = 256 << 20
    archive_total_uncompressed_bytes: int = 500 << 20
    archive_expansion_ratio: int = 200
    image_segments: int = 16_384
    image_metadata_bytes: int = 1 << 20
    image_width: int = 100_000
    image_height: int = 100_000
    image_pixels: int = 100_000_000

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) <= 0:
                raise ValueError(f"{f.name} must be greater than zero")
        if max(self.json_nesting_depth, self.xml_nesting_depth) > 128:
            raise ValueError("a nesting depth cannot exceed 128")

    def check(self, name: str, actual: int) -> int:
        return within(name, actual, getattr(self, name))


DEFAULT = Limits()
