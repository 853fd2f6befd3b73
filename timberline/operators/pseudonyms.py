"""Stable pseudonyms, numbered by first appearance, for both kinds of records.

Two passes: every record lists what it holds, in the order in which a sequential reader would meet it;
each distinct value gets the number of its first appearance. Then each record gets the pseudonyms of its
own values (never the whole dictionary) and is rewritten, syslog records by column expressions. The records' order is data (file and line
number), so the numbering doesn't depend on partitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.events import masked_event
from timberline.functions.text import BLANKS, META_TYPE
from timberline.session import shared_folder

# fixed values: prefixes of pseudonyms by category, for syslog and for canonical records
SYSLOG_PREFIX = {"hosts": "HOST", "users": "USER", "pids": "PID", "remote_hosts": "REMOTE_HOST", "ips": "IP", "ports": "PORT", "paths": "PATH", "commands": "CMD"}
CANONICAL_PREFIX = {"hosts": "HOST", "users": "USER", "pids": "PID", "remote_hosts": "REMOTE_HOST", "ports": "PORT"}
# fixed values: patterns of what is masked in messages
QUAD = r"(?U)\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
CONNECTION = r"(?U)(connection from\s+)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(\s+\()([^)]*)(\))"
RHOST, FROM_IP = r"(?U)(rhost=)(\S+)", r"(?U)(from\s+)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
FOR_USER, USER_IS = r"(?U)(for user\s+)(\S+)", r"(?U)(?<!\w)(user=)(\S+)"
COMMAND = r"(?d)COMMAND=(.+)$"
IN_MESSAGE = re.compile(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")
PORT = re.compile(r"\bport\s+(\d+)\b")
SESSION_USER = re.compile(r"session (?:opened|closed) for user ([A-Za-z0-9_\-.]+)")

Token = Callable[[str, str], str]
ROW_KEY = ["file_path", "line_number"]
_SEEN = "file_path string, line_number bigint, category string, value string, step int"


_ENTRIES = "cast(array() as array<struct<category:string,value:string>>)"
_IS_IP = r"rlike r'(?U)^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$'"


def _sql_staged(df: DataFrame, columns: list[str], new: dict[str, str]) -> DataFrame:
    """As ``staged``, of SQL expressions; ``columns`` are those of ``df``. Few calls make small work of a long chain."""
    keep = [f"`{c}`" for c in columns if c not in new]
    row = ", ".join(f"'{k}', {v}" for k, v in new.items())
    return df.selectExpr(*keep, f"explode_outer(array(named_struct({row}))) as __one").selectExpr(*keep, *[f"__one.{k} as {k}" for k in new])


def _replaced(pattern: str, put: Callable[[Callable[[int], str]], str]) -> str:
    """SQL of ``__text`` with every match of a pattern replaced by ``put`` of its groups."""
    pieces = f"split(__text, r'{pattern}', -1)"
    made = put(lambda g: f"regexp_extract_all(__text, r'{pattern}', {g})[i]")
    return f"if(__text rlike r'{pattern}', concat({pieces}[0], array_join(transform(regexp_extract_all(__text, r'{pattern}', 1), (g, i) -> concat({made}, {pieces}[i + 1])), '')), __text)"


def _found(pattern: str, group: int, kind: str) -> str:
    """SQL of (category, value) of one group of every match."""
    return f"if(__text rlike r'{pattern}', transform(regexp_extract_all(__text, r'{pattern}', {group}), v -> named_struct('category', {kind}, 'value', v)), {_ENTRIES})"


def _kind(value: str) -> str:
    return f"if({value} {_IS_IP}, 'ips', 'remote_hosts')"


def _nothing(category: str, value: str) -> str:
    return "''"


def _lookup(category: str, value: str) -> str:
    """The row's own pseudonym of a value; one that the dictionary lacks must not come through."""
    return f"coalesce(try_element_at(__own, concat('{category}|', {value})), '{SYSLOG_PREFIX[category]}_UNKNOWN')"


def _either(token: Callable[[str, str], str], value: str) -> str:
    return f"if({value} {_IS_IP}, {token('ips', value)}, {token('remote_hosts', value)})"


# of a pair of metadata, m: its value, and the category under which that is masked, null for none
_META_VALUE = "coalesce(m.value, 'None')"
_META_KIND = f"""case when m.key = 'user' then 'users' when coalesce(m.value, '') = '' then null when m.key = 'ruser' then 'users'
    when m.key = 'rhost' then {_kind('m.value')} when m.key = 'source_ip' then 'ips' when m.key = 'source_host' then 'remote_hosts' end"""


def _message_steps(rows: DataFrame, columns: list[str], token: Callable[[str, str], str]) -> tuple[DataFrame, list[str]]:
    """``rows`` with ``__text``, the message with everything personal replaced, step after step; ``__seen``,
    the (category, value) that the steps met, without commands; and ``__command``, what a command's
    pseudonym stands for, null without one. ``columns`` are those of ``rows``; also returns all names."""
    df = _sql_staged(rows, columns, {"__text": "coalesce(message, '')", "__seen": _ENTRIES})
    columns = [*columns, "__text", "__seen"]

    def step(df: DataFrame, pattern: str, put: Callable[[Callable[[int], str]], str], *seen: str) -> DataFrame:
        return _sql_staged(df, columns, {"__text": _replaced(pattern, put), "__seen": f"concat(__seen, {', '.join(seen)})"})

    some = f"trim(BOTH '{BLANKS}' FROM "
    named = f"filter({_found(CONNECTION, 4, repr('remote_hosts'))}, x -> {some}x.value) <> '')"
    df = step(df, CONNECTION, lambda g: f"concat({g(1)}, {token('ips', g(2))}, {g(3)}, if({some}{g(4)}) <> '', {token('remote_hosts', g(4))}, ''), {g(5)})", _found(CONNECTION, 2, "'ips'"), named)
    df = step(df, RHOST, lambda g: f"concat({g(1)}, {_either(token, g(2))})", _found(RHOST, 2, _kind("v")))
    df = step(df, FROM_IP, lambda g: f"concat({g(1)}, {token('ips', g(2))})", _found(FROM_IP, 2, "'ips'"))
    df = step(df, FOR_USER, lambda g: f"concat({g(1)}, {token('users', g(2))})", _found(FOR_USER, 2, "'users'"))
    df = step(df, USER_IS, lambda g: f"concat({g(1)}, {token('users', g(2))})", _found(USER_IS, 2, "'users'"))
    df = _sql_staged(df, columns, {"__command": f"if(contains(__text, 'COMMAND='), nullif(regexp_extract(__text, r'{COMMAND}', 1), ''), null)"})
    columns = [*columns, "__command"]
    df = _sql_staged(df, columns, {"__text": f"if(__command is not null, concat(left(__text, length(__text) - length(__command)), {token('commands', '__command')}), __text)"})
    columns = [*[c for c in columns if c != "__text"], "__text"]
    return step(df, QUAD, lambda g: token("ips", g(1)), _found(QUAD, 1, "'ips'")), columns


def _listed(rows: DataFrame) -> DataFrame:
    """What syslog records hold, in the order in which a reader would meet it; commands come later."""
    df, _ = _message_steps(rows.select(*ROW_KEY, "hostname", "pid", "message", "metadata"), [*ROW_KEY, "hostname", "pid", "message", "metadata"], _nothing)
    own = "array_compact(array(if(hostname is null, null, named_struct('category', 'hosts', 'value', hostname)), if(pid is null, null, named_struct('category', 'pids', 'value', cast(cast(pid as bigint) as string)))))"
    meta = f"transform(filter(coalesce(metadata, cast(array() as {META_TYPE})), m -> {_META_KIND} is not null), m -> named_struct('category', {_META_KIND}, 'value', {_META_VALUE}))"
    every = df.selectExpr(*ROW_KEY, "__command is not null as command", f"posexplode(concat({own}, __seen, {meta})) as (step, x)")
    return every.selectExpr(*ROW_KEY, "x.category", "x.value", "step", "command")


def _own_tokens(known: DataFrame, columns: list[str]) -> DataFrame:
    return _sql_staged(known, columns, {"__own": "map_from_entries(array_distinct(transform(tokens, t -> struct(concat(t.category, '|', t.value), t.token))))"})


def _commands(known: DataFrame) -> DataFrame:
    """What the commands' pseudonyms stand for, once the rest of the text is masked."""
    columns = [*ROW_KEY, "message", "tokens"]
    with_command = known.filter(F.contains("message", F.lit("COMMAND="))).select(*columns)
    df, _ = _message_steps(_own_tokens(with_command, columns), [*columns, "__own"], _lookup)
    return df.selectExpr(*ROW_KEY, "'commands' as category", "__command as value", "0 as step").filter("value is not null")


def _masked_syslog(known: DataFrame, names: list[str]) -> DataFrame:
    columns = known.columns
    df, columns = _message_steps(_own_tokens(known, columns), [*columns, "__own"], _lookup)
    masked = f"case {_META_KIND} " + " ".join(f"when '{c}' then {_lookup(c, _META_VALUE)}" for c in ("users", "ips", "remote_hosts")) + " end"
    meta = f"transform(metadata, m -> if({_META_KIND} is null, m, named_struct('key', m.key, 'value', {masked}, 'vtype', 'string')))"
    df = _sql_staged(df, columns, {"__host": f"if(hostname is null, null, {_lookup('hosts', 'hostname')})", "__pid": f"if(pid is null, null, {_lookup('pids', 'cast(cast(pid as bigint) as string)')})", "__meta": f"cast({meta} as {META_TYPE})"})
    line = "concat(coalesce(timestamp, 'None'), ' ', coalesce(__host, 'None'), ' ', coalesce(process, 'None'), if(coalesce(component, '') <> '', concat('(', component, ')'), ''), if(__pid is not null, concat('[', __pid, ']'), ''), ': ', __text)"
    new = {"hostname": "__host", "pid": "__pid", "message": "__text", "metadata": "__meta"}
    return df.selectExpr(*[f"{new[c]} as {c}" if c in new else f"`{c}`" for c in names], f"{line} as masked_log")


def replaced_words(text: str, tokens: dict[str, str]) -> str:
    """Every whole word that is a key replaced, the longest keys first."""
    if not tokens:
        return text
    keys = sorted(tokens, key=lambda k: -len(k))
    return re.sub(r"\b(" + "|".join(map(re.escape, keys)) + r")\b", lambda m: tokens[m[1]], text)


def _mask_canonical(row: dict, token: Token) -> dict:
    message, raw = row["message"] or "", row["raw_log"] or ""
    host = token("hosts", row["hostname"]) if row["hostname"] else row["hostname"]
    pid = token("pids", str(row["pid"])) if row["pid"] is not None else None
    meta = {m["key"]: dict(m) for m in row["metadata"]}
    said = SESSION_USER.search(message) if row["event"] in ("session_opened", "session_closed") else None
    if said:
        meta["user"] = {"key": "user", "value": said[1], "vtype": "string"}
    local: dict[str, str] = {}
    for key, category in (("user", "users"), ("ruser", "users"), ("rhost", "remote_hosts")):
        value = meta[key]["value"] if key in meta else None
        if value:
            local[value] = token(category, value)
            meta[key] = {"key": key, "value": local[value], "vtype": "string"}
    for ip in IN_MESSAGE.findall(message):
        local[ip] = token("remote_hosts", ip)
    for m in PORT.finditer(message):
        local[m[1]] = token("ports", m[1])
    masked = replaced_words(message, local)
    if pid is not None:
        local[str(row["pid"])] = pid
    if row["hostname"]:
        local[row["hostname"]] = host
    return {"hostname": host, "pid": pid, "message": masked, "metadata": list(meta.values()), "masked_log": replaced_words(raw, local)}


def _records(records: DataFrame, canonical: bool) -> DataFrame:
    if canonical:
        records = records.withColumn("event", masked_event(F.coalesce(F.col("message"), F.lit(""))))
    return records


def dictionary(records: DataFrame, canonical: bool = False) -> DataFrame:
    """(category, value, ordinal, token): every value that is masked, numbered by first appearance.

    Records are ordered by file and line number. A command's value is its text after all other masking,
    so commands are numbered in a second round.
    """
    rows = _records(records, canonical)
    return _dictionary(rows, _seen_once(rows, canonical), canonical)


def _seen_once(rows: DataFrame, canonical: bool) -> DataFrame:
    """What the records hold, listed once for the numbers and for each record's own values."""
    shared_folder(rows.sparkSession, "seen")
    return (rows.mapInPandas(_lister, _SEEN) if canonical else _listed(rows)).checkpoint()


def grown(records: DataFrame, known: DataFrame) -> DataFrame:
    """The dictionary ``known`` of syslog records with what these hold besides, numbered behind it."""
    return _dictionary(records, _seen_once(records, False), False, known)


def _dictionary(rows: DataFrame, seen: DataFrame, canonical: bool, known: DataFrame | None = None) -> DataFrame:
    if canonical:
        return _numbered(seen, CANONICAL_PREFIX, known)
    first = _numbered(seen, SYSLOG_PREFIX, known)
    # a command's value has the pseudonyms of all of its text in it
    commands = _commands(_with_tokens(rows.filter(F.contains("message", F.lit("COMMAND="))), seen.filter("command"), first))
    return first.filter("category <> 'commands'").unionByName(_numbered(commands, SYSLOG_PREFIX, None if known is None else known.filter("category = 'commands'")))


def _lister(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What canonical records hold."""
    for pdf in batches:
        out: list[tuple] = []
        for row in pdf.to_dict("records"):
            step = 0

            def token(category: str, value: str, row=row) -> str:
                nonlocal step
                out.append((row["file_path"], row["line_number"], category, value, step))
                step += 1
                return ""

            _mask_canonical(row, token)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SEEN.split(", ")])


def _numbered(seen: DataFrame, prefix: dict[str, str], known: DataFrame | None = None) -> DataFrame:
    """Distinct values numbered by first appearance in their category, behind those of ``known``.

    The values are sorted over all tasks; a task's numbers start behind those of the tasks before it.
    """
    shared_folder(seen.sparkSession, "numbers")
    first = seen.groupBy("category", "value").agg(F.min(F.struct("file_path", "line_number", "step")).alias("first"))
    if known is not None:
        first = first.join(known.select("category", "value"), ["category", "value"], "left_anti")
    first = first.checkpoint()  # sorting reads it twice
    placed = first.repartitionByRange("category", "first").sortWithinPartitions("category", "first").select("category", "value", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("id")).checkpoint()
    ahead = F.sum("n").over(Window.partitionBy("category").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    parts = placed.groupBy("category", "task").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("before", F.coalesce(ahead, F.lit(0)))  # a row for each task
    last = F.lit(0)
    if known is not None:
        parts = parts.join(known.groupBy("category").agg(F.max("ordinal").alias("last")), "category", "left")
        last = F.coalesce("last", F.lit(0))
    name = F.create_map(*[F.lit(x) for kv in prefix.items() for x in kv])[F.col("category")]
    ranked = placed.join(parts, ["category", "task"]).select("category", "value", (F.col("id") - F.col("least") + F.col("before") + last + 1).cast("int").alias("ordinal"))
    new = ranked.withColumn("token", F.format_string("%s_%03d", name, F.col("ordinal")))
    return new if known is None else known.select(*new.columns).unionByName(new)


def _with_tokens(rows: DataFrame, seen: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each record with the array of its own values' tokens."""
    mine = seen.select(*ROW_KEY, "category", "value").join(tokens.select("category", "value", "token"), ["category", "value"])
    per_row = mine.groupBy(*ROW_KEY).agg(F.collect_set(F.struct("category", "value", "token")).alias("tokens"))
    joined = rows.join(per_row, ROW_KEY, "left")
    return joined.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<struct<category:string,value:string,token:string>>")))


def pseudonymised(records: DataFrame, tokens: DataFrame | None = None, canonical: bool = False, keep_raw: bool = True) -> DataFrame:
    """The records with pseudonyms, and ``masked_log``, the masked line.

    ``records`` come from parse_syslog, or with ``canonical`` from parse_lines or canonical; one row per
    file and line. pid becomes a text. Canonical records get the event that masking derives again.
    Without ``keep_raw`` the column raw_log, which is personal, is left out. A value that ``tokens`` lacks
    becomes UNKNOWN.
    """
    rows = _records(records, canonical)
    seen = _seen_once(rows, canonical)
    if tokens is None:
        tokens = _dictionary(rows, seen, canonical)
    known = _with_tokens(rows, seen, tokens)
    kinds = dict(rows.dtypes) | {"pid": "string", "metadata": META_TYPE}
    names = [c for c in rows.columns if keep_raw or c != "raw_log"]
    if not canonical:
        # a command's own key is known once the rest of its text is masked
        commands = tokens.filter("category = 'commands'").select("category", "value", "token")
        with_command = _with_tokens(rows.filter(F.contains("message", F.lit("COMMAND="))), seen.filter("command"), tokens)
        extra = _commands(with_command).join(commands, ["category", "value"]).groupBy(*ROW_KEY).agg(F.collect_list(F.struct("category", "value", "token")).alias("_c"))
        known = known.join(extra, ROW_KEY, "left").withColumn("tokens", F.when(F.col("_c").isNotNull(), F.concat("tokens", "_c")).otherwise(F.col("tokens"))).drop("_c")
        return _masked_syslog(known, names)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", masked_log string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                own = {(t["category"], t["value"]): t["token"] for t in row["tokens"]}
                # a value that the dictionary lacks must not come through
                out.append(row | _mask_canonical(row, lambda c, v, own=own: own.get((c, v)) or f"{CANONICAL_PREFIX[c]}_UNKNOWN"))
            yield pd.DataFrame(out, columns=[*names, "masked_log"])

    return known.mapInPandas(run, schema)


def masking_quality(records: DataFrame, masked: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: shares of records whose event and process stayed and whose message changed, in percent,
    the number of values by category, and the share of values with one token."""
    a = records.select(*ROW_KEY, F.col("event").alias("e0"), F.col("process").alias("p0"), F.col("message").alias("m0"))
    both = a.join(masked.select(*ROW_KEY, "event", "process", "message"), ROW_KEY)
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")) * 100, F.lit(0.0)), 2)
    agg = both.agg(F.count("*").alias("records"), share(F.col("e0").eqNullSafe(F.col("event"))).alias("event_kept"), share(F.col("p0").eqNullSafe(F.col("process"))).alias("process_kept"), share(~F.col("m0").eqNullSafe(F.col("message"))).alias("message_changed"))
    sizes = tokens.groupBy().agg(*[F.count_if(F.col("category") == c).alias(c) for c in SYSLOG_PREFIX], F.count_distinct("category", "value").alias("values"))
    size = sizes.select(F.struct("*").alias("s")).scalar()
    return agg.select("*", *[size[c].alias(c) for c in (*SYSLOG_PREFIX, "values")])
