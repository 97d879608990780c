"""Stage reports: what a stage counted, beside its data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Report:
    """Named figures of a stage.  ``of`` reads them from a one-row aggregate."""

    stage: str
    values: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, stage: str, one_row: DataFrame, **more: Any) -> Report:
        return cls(stage, one_row.first().asDict(recursive=True) | more)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def to_dict(self) -> dict[str, Any]:
        return {"stage": self.stage, **self.values}

    def to_json(self, path: str | None = None) -> str:
        text = json.dumps(self.to_dict(), ensure_ascii=False, indent=2, default=str)
        if path:
            Path(path).write_text(text, encoding="utf-8")
        return text

    def summary(self) -> str:
        return "\n".join([f"[{self.stage}]", *(f"  {k}: {v}" for k, v in self.values.items())])
