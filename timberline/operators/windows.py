"""Windows of consecutive lines, the split in time, and synthetic attacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.ranks import at_ranks

SIZE = 10
BLOCK = 1 << 16

# fixed values: the lines of the synthetic attacks
BRUTE_FORCE = ("sshd-session | authentication_failure | rhost=REMOTE_HOST_005 user=USER_001 uid=0 | Failed password for root from REMOTE_HOST_005 port 22 ssh2",) * 8
SUDO_ABUSE = ("sudo | sudo_command | user=USER_099 uid=1005 | USER_099 : TTY=pts/0 ; PWD=/home/USER_099 ; USER=root ; COMMAND=/bin/bash",)
ABNORMAL_CLOSE = (
    "systemd-logind | session_closed | session=999 | Session 999 logged out. Waiting for processes to exit.",
    "systemd-logind | session_closed | session=999 | Failed to stop session 999, process still running.",
)
REMOTE_LOGIN = ("sshd-session | authentication_success | rhost=REMOTE_HOST_999 user=USER_001 | Accepted publickey for root from REMOTE_HOST_999 port 55555 ssh2",)


def ranked(lines: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """``lines`` with ``rank``, the 0-based place in the order of the columns over all files.

    No window spans the whole table: rows are ranked inside blocks of a file's line numbers, and the
    blocks' sizes, a small table, are summed up before.
    """
    df = lines.withColumn("_block", F.floor(F.col("line_number") / block).cast("bigint"))
    inside = Window.partitionBy("file_path", "_block").orderBy(*order)
    sizes = df.groupBy("file_path", "_block").agg(F.count("*").alias("_n"))
    # blocks in groups by file, then the groups: neither window holds more than files or a file's blocks
    files = sizes.groupBy("file_path").agg(F.sum("_n").alias("_of_file"))
    ahead = F.sum("_of_file").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select(F.col("file_path").alias("_f"), F.coalesce(ahead, F.lit(0)).alias("_files_before"))
    before = F.sum("_n").over(Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("file_path", "_block", F.coalesce(before, F.lit(0)).alias("_before")).join(files, F.col("file_path") == F.col("_f")).select(F.col("file_path").alias("_f"), F.col("_block").alias("_b"), (F.col("_before") + F.col("_files_before")).alias("_start"))
    at = df.withColumn("_r", F.row_number().over(inside) - 1)
    return at.join(starts, (F.col("file_path") == F.col("_f")) & (F.col("_block") == F.col("_b"))).withColumn("rank", F.col("_start") + F.col("_r")).drop("_block", "_r", "_f", "_b", "_start")


def count_windows(lines: DataFrame, size: int = SIZE, order: list[str] | None = None) -> DataFrame:
    """(window_id, lines, text) of ``size`` consecutive lines each; an incomplete last window is dropped."""
    order = order or ["line_number"]
    rows = ranked(lines, order).withColumn("window_id", F.floor(F.col("rank") / size).cast("bigint"))
    grouped = rows.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x")).filter(F.size("x") == size)
    return grouped.select("window_id", F.transform("x", lambda r: r["line"]).alias("lines"), F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))


def split_windows(windows: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """``windows`` with ``part``: train for the first ones, test for the last fraction."""
    n = windows.select(F.coalesce(F.max("window_id") + 1, F.lit(0))).scalar()
    return windows.withColumn("part", F.when(F.col("window_id") < F.floor(n * F.lit(1 - test_fraction)), "train").otherwise("test"))


Injector = Callable[[Column, Column], Column]


def _around(lines: Column, n: Column, added: tuple[str, ...], before: int, after: int) -> Column:
    """``lines`` without the middle ones (from middle - before to middle + after), with others there."""
    middle = F.floor(n / 2).cast("int")
    return F.concat(F.slice(lines, F.lit(1), F.greatest(middle - before, F.lit(0))), F.array(*[F.lit(x) for x in added]), F.slice(lines, middle + after + 1, F.greatest(n - middle - after, F.lit(0))))


def inject_brute_force(lines: Column, n: Column) -> Column:
    return F.when(n >= 5, _around(lines, n, BRUTE_FORCE, 2, 2)).otherwise(lines)


def inject_sudo_abuse(lines: Column, n: Column) -> Column:
    return F.when(n >= 3, _around(lines, n, SUDO_ABUSE, 0, 1)).otherwise(lines)


def inject_abnormal_close(lines: Column, n: Column) -> Column:
    return F.when(n >= 3, _around(lines, n, ABNORMAL_CLOSE, 0, 1)).otherwise(lines)


def inject_remote_login(lines: Column, n: Column) -> Column:
    return F.when(n >= 3, _around(lines, n, REMOTE_LOGIN, 0, 1)).otherwise(lines)


INJECTORS: list[Injector] = [inject_brute_force, inject_sudo_abuse, inject_abnormal_close, inject_remote_login]


def register_injector(injector: Injector) -> None:
    INJECTORS.append(injector)


def draw(window_id: Column, seed: int) -> Column:
    """A number of the window below 2**32 that other engines can compute too."""
    return F.pmod((window_id + seed) * 2654435761, F.lit(1 << 32))


def with_attacks(windows: DataFrame, ratio: float = 0.1, seed: int = 7) -> DataFrame:
    """``windows`` with ``label``: a share of them, drawn by seed, get 1 and an attack in their middle.

    The kind of attack goes by the window's number. Windows too short for theirs stay as they are, with label 1.
    """
    wanted = int(windows.count() * ratio)
    # the draw differs for every window below 2**32; those up to the wanted one's are taken
    limit = at_ranks(windows, draw(F.col("window_id"), seed), [wanted - 1])[0] if wanted else -1
    chosen = draw(F.col("window_id"), seed) <= limit
    df = windows
    size = F.size("lines")
    kind = F.pmod(F.col("window_id"), F.lit(len(INJECTORS)))
    attacked = F.col("lines")
    for i, f in enumerate(INJECTORS):
        attacked = F.when(kind == i, f(F.col("lines"), size)).otherwise(attacked)
    lines = F.when(chosen, attacked).otherwise(F.col("lines"))
    return df.select(*[c for c in windows.columns if c not in ("lines", "text")], lines.alias("lines"), F.array_join(lines, "\n").alias("text"), F.when(chosen, 1).otherwise(0).alias("label"))
