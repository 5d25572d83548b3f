"""Totals of the keys that many blocks hold, answered to each block in the order in which it sent them.

A block (a unit) sends its distinct 64-bit keys, sorted, with counts, to ranges of the key space: a row for each range, packed. A range adds up its keys
and answers every row with the totals of the keys in it, and no others. Keys are hashes, so ranges are even.

With few ranges one step does. With more, a row for each unit and range would hold ever fewer keys, and a range would see a row of
every unit. So there are levels of at most FAN ranges each: a level's rows are merged over groups of about FAN units (equal keys of a group become one), cut into
the next level's ranges and sent on as one unit; on the way back the group's totals are handed to its members. Rows hold about as
many keys at each level, and a call never holds more than about FAN rows or the keys of one range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coding import pack, unpack
from .store import arrow

FAN = 256
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


@dataclass(frozen=True)
class Plan:
    fan: int  #: ranges of a level
    depth: int  #: levels
    groups: tuple[int, ...]  #: units after each level but the last


def plan(ranges: int, units: int) -> Plan:
    """Levels for at least so many ranges."""
    depth = 1
    while FAN**depth < ranges:
        depth += 1
    fan = next(f for f in range(max(1, int(ranges ** (1 / depth)) - 1), FAN + 1) if f**depth >= ranges)
    groups = []
    for _ in range(depth - 1):
        units = max(1, -(-units // FAN))
        groups.append(units)
    return Plan(fan, depth, tuple(groups))


def _place(keys: np.ndarray, fan: int, level: int) -> np.ndarray:
    """The range of each key among its parent's."""
    h = keys >> _HALF
    for _ in range(level - 1):
        h = h * np.uint64(fan) & _LOW
    return (h * np.uint64(fan) >> _HALF).astype(np.int64)


def schema(columns: int) -> str:
    return "range bigint, unit bigint, keys binary" + "".join(f", c{i} binary" for i in range(columns))


def answer_schema(columns: int) -> str:
    return "range bigint, unit bigint" + "".join(f", t{i} binary" for i in range(columns)) + ", marked bigint"


def rows(unit: int, keys: np.ndarray, counts: list[np.ndarray], fan: int, level: int = 1, parent: int = 0) -> dict[str, list]:
    """What a unit sends: a row for each range that it has keys in. keys: sorted, of one parent range."""
    ends = np.searchsorted(_place(keys, fan, level), np.arange(fan + 1))
    some = np.flatnonzero(np.diff(ends))
    part = [slice(ends[r], ends[r + 1]) for r in some]
    out = {"range": parent * fan + some, "unit": [unit] * len(some), "keys": [pack(keys[p], True) for p in part]}
    return out | {f"c{i}": [pack(c[p]) for p in part] for i, c in enumerate(counts)}


def _added(table: dict, columns: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Each row's keys, all distinct keys sorted, and their sums."""
    sent = [unpack(k, np.uint64, True) for k in table["keys"]]
    keys, at = np.unique(np.concatenate(sent), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([unpack(x, np.uint64) for x in table[f"c{i}"]]), len(keys)).astype(np.uint64) for i in range(columns)]
    return sent, keys, sums


def _handed(table: dict, sent: list[np.ndarray], keys: np.ndarray, totals: list[np.ndarray], marked: int, out: pa.Schema) -> pa.Table:
    back = {"range": table["range"], "unit": table["unit"], "marked": [marked] + [0] * (len(sent) - 1)}
    at = [np.searchsorted(keys, k) for k in sent]
    back |= {f"t{i}": [pack(t[a]) for a in at] for i, t in enumerate(totals)}
    return pa.table({n: pa.array(back[n], out.field(n).type) for n in out.names}, schema=out)


def _sum(columns: int, mark: int) -> Callable[[pa.Table], pa.Table]:
    out = arrow(answer_schema(columns))

    def fn(group: pa.Table) -> pa.Table:
        table = group.to_pydict()
        sent, keys, sums = _added(table, columns)
        marked = int(((keys & np.uint64(mark) != 0) & (sums[0] > 0)).sum()) if mark else 0
        return _handed(table, sent, keys, sums, marked, out)

    return fn


def _merge(columns: int, fan: int, level: int) -> Callable[[tuple, pa.Table], pa.Table]:
    out = arrow(schema(columns))

    def fn(group: tuple, members: pa.Table) -> pa.Table:
        _, keys, sums = _added(members.to_pydict(), columns)
        on = rows(group[1].as_py(), keys, sums, fan, level + 1, group[0].as_py())
        return pa.table({n: pa.array(on[n], out.field(n).type) for n in out.names}, schema=out)

    return fn


def _back(columns: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    out = arrow(answer_schema(columns))

    def fn(members: pa.Table, answers: pa.Table) -> pa.Table:
        if not members.num_rows:
            return out.empty_table()
        table, a = members.to_pydict(), answers.sort_by("range").to_pydict()
        sent, keys, _ = _added(table, 0)
        totals = [np.concatenate([unpack(x, np.uint64) for x in a[f"t{i}"]]) for i in range(columns)]
        return _handed(table, sent, keys, totals, sum(a["marked"]), out)

    return fn


def totals(asked: DataFrame, p: Plan, columns: int, mark: int = 0, level: int = 1) -> DataFrame:
    """For rows() of all units at a level: the same ranges and units with totals t0, t1, ...; a unit's answers in order of `range` are in order of its keys.

    The sum of `marked` over a level's rows is how many distinct keys with the bit `mark` have a positive total in column 0.
    """
    if level == p.depth:
        return asked.groupBy("range").applyInArrow(_sum(columns, mark), answer_schema(columns))
    grouped = asked.withColumn("up", F.pmod(F.xxhash64("unit", F.lit(level)), F.lit(p.groups[level - 1])))
    merged = grouped.groupBy("range", "up").applyInArrow(_merge(columns, p.fan, level), schema(columns))
    answers = totals(merged, p, columns, mark, level + 1).withColumn("parent", F.expr(f"range div {p.fan}"))
    return grouped.groupBy("range", "up").cogroup(answers.groupBy("parent", "unit")).applyInArrow(_back(columns), answer_schema(columns))
