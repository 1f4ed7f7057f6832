"""Rule ids, dates and globs of the configuration, read on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

_PART = "[a-z0-9]+(?:-[a-z0-9]+)*"
#: A namespaced rule id, as rlike() takes it.
RULE_ID = f"\\A{_PART}/{_PART}\\z"
#: YYYY-MM-DD with month 1-12 and day 1-31; month lengths are not checked, as dates are only compared.
DATE = "\\A[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\\z"


@dataclass(frozen=True, order=True)
class RuleId:
    """Ordered by the pair, not by the rendered text."""

    namespace: str
    name: str

    @classmethod
    def parse(cls, text: str) -> RuleId:
        if not re.fullmatch(f"{_PART}/{_PART}", text):
            raise ValueError(f"`{text}` is not a rule id: lower-case letters, digits and single hyphens, as namespace/name")
        return cls(*text.split("/"))

    def __str__(self) -> str:
        return f"{self.namespace}/{self.name}"


def is_date(text: str) -> bool:
    return re.fullmatch(DATE[2:-2], text) is not None
