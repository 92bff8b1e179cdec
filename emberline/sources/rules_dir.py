"""Rule directories: every ``*.toml`` below a folder, by path."""

from __future__ import annotations

from pathlib import Path

from ..plans.catalog import FieldCatalog, RuleError
from ..plans.rules import RuleSnapshot, compile_rules


def rule_texts(folder: str | Path) -> list[str]:
    """Texts in load order, which is evaluation order; the first unreadable file ends the load."""
    folder = Path(folder)
    if not folder.exists():
        raise RuleError("RulePathNotFound", f"No rule file found at '{folder}'")
    return [p.read_text(encoding="utf-8") for p in sorted(folder.rglob("*.toml"))]


def load_rules(folder: str | Path, catalog: FieldCatalog, allow_empty: bool = False) -> RuleSnapshot:
    return compile_rules(rule_texts(folder), catalog, allow_empty)


class RuleDirectory:
    """A directory that may change: a good new state replaces the snapshot, a bad one leaves it."""

    def __init__(self, folder: str | Path, catalog: FieldCatalog):
        self.folder, self.catalog = Path(folder), catalog
        self.stamp = self._stamp()
        self.snapshot = load_rules(folder, catalog)
        self.version, self.last_error = 1, ""

    def _stamp(self) -> tuple:
        return tuple(sorted((str(p), p.stat().st_mtime_ns, p.stat().st_size) for p in self.folder.rglob("*.toml")))

    def refresh(self) -> RuleSnapshot:
        """The current snapshot, reloaded if files changed; an empty directory is allowed here."""
        stamp = self._stamp()
        if stamp != self.stamp:
            self.stamp = stamp
            try:
                self.snapshot = load_rules(self.folder, self.catalog, allow_empty=True)
                self.version, self.last_error = self.version + 1, ""
            except (RuleError, OSError) as e:
                self.last_error = str(e)
        return self.snapshot
