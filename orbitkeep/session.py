"""A session: settings of a reader or writer, and the operators under them.

Sessions hold no state of the store; each method takes tables and returns a
table.  Names are transformed to ids where a table has a name and no id.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import keys
from .model import ENXIO, StoreError
from .operators import reads, replies, routes, scan, transfer, writes


@dataclass(frozen=True)
class Session:
    """``with_`` returns a changed copy.

    groups: in the order in which they are asked; namespace: of names; accept:
    a filter of replies; checker: when a request has succeeded; timestamp: of
    writes (null: the table's ts_sec); digits: hex digits of ids; raises:
    whether a request that fails its checker is an exception rather than a row.
    """

    groups: tuple[int, ...] = (1,)
    namespace: str | None = None
    accept: str | Column = "positive"
    checker: object = "at_least_one"
    timestamp: int | None = None
    digits: int = 64
    raises: bool = False

    def with_(self, **changes) -> Session:
        return replace(self, **changes)

    def ids(self, table: DataFrame) -> DataFrame:
        """``table`` with an id: its own, or that of its name."""
        if "id" in table.columns:
            return table
        return table.withColumn("id", keys.transform(F.col("name"), self.namespace, 4 * self.digits))

    def _in_groups(self, records: DataFrame) -> DataFrame:
        if not self.groups:
            raise StoreError(ENXIO, "the session has no groups")
        return records.filter(F.col("group_id").isin(list(self.groups)))

    # -- reading
    def read(self, records: DataFrame, wanted: DataFrame, columns: tuple[str, ...] = reads.REPLICA) -> DataFrame:
        """Of each wanted key the replica in the first group that has it."""
        asked = self.ids(wanted).select("id").distinct()
        return reads.first_group(self._in_groups(records).join(asked, "id", "left_semi"), self.groups, columns)

    def bulk_read(self, records: DataFrame, wanted: DataFrame) -> DataFrame:
        return reads.bulk_read(self._in_groups(records), self.ids(wanted), self.groups)

    def read_latest(self, records: DataFrame, wanted: DataFrame) -> DataFrame:
        return reads.latest(self._in_groups(records).join(self.ids(wanted).select("id").distinct(), "id", "left_semi"))

    def lookup(self, records: DataFrame, wanted: DataFrame) -> DataFrame:
        return reads.lookup(self._in_groups(records), self.ids(wanted), self.groups)

    def parallel_lookup(self, records: DataFrame, wanted: DataFrame) -> DataFrame:
        return reads.present(self._in_groups(records)).join(self.ids(wanted).select("id").distinct(), "id", "left_semi")

    def quorum_lookup(self, records: DataFrame, wanted: DataFrame) -> DataFrame:
        return reads.quorum(self._in_groups(records), self.ids(wanted), self.groups)

    def owners(self, wanted: DataFrame, ring: DataFrame) -> DataFrame:
        """Who owns each key in the session's groups."""
        return routes.lookup(self.ids(wanted), self._in_groups(ring))

    def scan(self, records: DataFrame, ranges: list[tuple[str, str]] = (), time: tuple[int, int] = (0, 0), no_meta: bool = False) -> DataFrame:
        return scan.scan(self._in_groups(records), ranges, time, no_meta)

    # -- writing
    def write(self, records: DataFrame, values: DataFrame) -> DataFrame:
        """The records after ``values`` (name or id, ts_sec, size, ...) are written to all groups of the session."""
        rows = self.ids(values)
        if self.timestamp is not None:
            rows = rows.withColumn("ts_sec", F.lit(self.timestamp).cast("long"))
        rows = writes.to_groups(rows, self.groups)
        return writes.last_writer(records, rows.select(*[c for c in records.columns if c in rows.columns]))

    def remove(self, records: DataFrame, wanted: DataFrame) -> DataFrame:
        """The records after the keys are removed from the session's groups."""
        gone = writes.to_groups(self.ids(wanted).select("id").distinct(), self.groups)
        return writes.without(records, gone, ("id", "group_id"))

    def send(self, records: DataFrame, source: int, ranges: list[tuple[str, str]] = (), flags: int = 0) -> tuple[DataFrame, DataFrame]:
        """Copy or move what a group holds to the session's groups: outcomes, and the records afterwards."""
        return transfer.copy_scan(records, source, self.groups, ranges, flags=flags)

    # -- replies
    def shown(self, answers: DataFrame) -> DataFrame:
        return replies.shown(answers, self.accept)

    def outcome(self, answers: DataFrame) -> DataFrame:
        """Of each request whether it succeeded; with ``raises`` the first that did not is an exception."""
        rows = replies.outcome(answers, self.checker)
        if self.raises and (bad := rows.filter("NOT ok").first()) is not None:
            raise StoreError(-bad["error"], f"request {bad['id']}: {bad['successes']} of {bad['total']} replies are good")
        return rows
