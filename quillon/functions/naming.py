"""References to fields: dotted segments, then an optional column after the first dollar sign."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quillon.errors import UnknownField

REFERENCE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*(?:\$[A-Za-z_][\w$]*)?\Z")


@dataclass(frozen=True)
class FieldPath:
    segments: tuple[str, ...]
    column: str | None = None

    @classmethod
    def parse(cls, text: str) -> FieldPath:
        if not isinstance(text, str) or not REFERENCE.match(text):
            raise UnknownField(f"not a field reference: {text!r}")
        head, dollar, column = text.partition("$")
        return cls(tuple(head.split(".")), column if dollar else None)

    @property
    def alias(self) -> str:
        """The output name: product.category$caption is product_category$caption."""
        head = "_".join(self.segments)
        return head if self.column is None else f"{head}${self.column}"

    @property
    def dotted(self) -> str:
        head = ".".join(self.segments)
        return head if self.column is None else f"{head}${self.column}"

    @property
    def parent(self) -> FieldPath | None:
        return FieldPath(self.segments[:-1]) if len(self.segments) > 1 else None

    def child(self, segment: str) -> FieldPath:
        return FieldPath((*self.segments, segment))

    def with_column(self, column: str) -> FieldPath:
        return FieldPath(self.segments, column)

    @property
    def hierarchical(self) -> bool:
        return bool(self.column) and self.column.startswith("hierarchy$")


def camel(column: str) -> str:
    """order_date is orderDate; a name without underscores stays."""
    head, *rest = [p for p in column.split("_") if p] or [column]
    return head + "".join(p[:1].upper() + p[1:] for p in rest)
