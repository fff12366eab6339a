"""The ledger of a table's arrival numbers: every append owns a range of `seq`, and readers know which ranges are complete.

A small file per append lies in `_ledger` inside the table's folder, where readers of the table do not look.
`claim` sets a range aside before the write, `commit` says that its rows are all there, `void` that they never will be.
Files are made with the file system's create-if-absent (`folder`), so of two writers that want the same place one moves on to the next.

Claims of one stream name their epoch, so a repeated epoch gets the range it had, unless it has grown.  Only the driver works here, with one
file per append; the ranges' rows are never looked at.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from groundswell.sources.folder import Folder


@dataclass(frozen=True)
class Claim:
    number: int
    first: int
    end: int  # exclusive
    owner: str
    epoch: int | None


class Ledger:
    def __init__(self, spark: SparkSession, table: str):
        self.folder = Folder(spark, f"{table.rstrip('/')}/_ledger")

    def _names(self) -> list[str]:
        return self.folder.names()

    def _claim(self, name: str) -> Claim:
        return Claim(**json.loads(self.folder.read(name, last="}")))

    def claims(self) -> list[Claim]:
        return [self._claim(n) for n in self._names() if n.startswith("claim-")]

    def claim(self, count: int, owner: str, epoch: int | None = None) -> Claim:
        """A range of `count` numbers above all claimed so far; the same one again for the same owner and epoch."""
        names = [n for n in self._names() if n.startswith("claim-")]
        if epoch is not None:
            for name in reversed(names):
                earlier = self._claim(name)
                if earlier.owner == owner:
                    if earlier.epoch == epoch and earlier.end - earlier.first >= count:
                        return earlier
                    if earlier.epoch <= epoch:
                        break
        last = self._claim(names[-1]) if names else Claim(-1, 0, 0, "", None)
        while True:
            new = Claim(last.number + 1, last.end, last.end + count, owner, epoch)
            if self.folder.create(f"claim-{new.number:012d}", json.dumps(new.__dict__)):
                return new
            last = self._claim(f"claim-{new.number:012d}")

    def commit(self, claim: Claim) -> None:
        self.folder.create(f"done-{claim.number:012d}")

    def void(self, claim: Claim) -> None:
        """Give up a range whose write has failed; its rows, if any were written, must not become visible."""
        self.folder.create(f"void-{claim.number:012d}")

    def mark(self) -> int:
        """The number below which everything is stored: the start of the first range that is neither complete nor given up."""
        names = set(self._names())
        claimed = sorted(n for n in names if n.startswith("claim-"))
        for name in claimed:
            number = name.removeprefix("claim-")
            if f"done-{number}" not in names and f"void-{number}" not in names:
                return self._claim(name).first
        return self._claim(claimed[-1]).end if claimed else 0
