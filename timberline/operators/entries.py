"""Physical log lines of any layout to entries with timestamp, level, process, component and message.

A deterministic machine reads each line character by character: one automaton, built from templates,
recognises time stamps of every layout at once; small scanners take brackets, quotes, priorities and
key=value pairs; grammars over what they delivered assign the fields. A line without a header of its
own is attached to the entry before it. Lines are read in chunks of each file's line numbers, so a huge
file is spread over tasks; the entry that a chunk leaves open is completed from the chunks after it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.vocab import FIELD_OF, PRIORITY, SEVERITY

CHUNK = 1 << 16

# 9 a digit, a a letter; a mark after a character or [set] repeats it (+) or makes it optional (?)
STAMPS = {
    "iso": ("9999[-/]99[-/]99[T ]99:99:99", "9999[-/]99[-/]99[T ]99:99:99[.,]9+"),
    "zoned": tuple(f"9999[-/]99[-/]99[T ]99:99:99{f}{z}" for f in ("", "[.,]9+") for z in ("Z", " ?[-+]99:?99")),
    "bsd": ("aaa  ?9?9 99:99:99", "aaa  ?9?9 99:99:99.9+"),
    "ctime": ("aaa aaa  ?9?9 99:99:99 9999", "aaa aaa  ?9?9 99:99:99.9+ 9999"),
    "us": ("9?9/9?9/9999 9?9:99:99", "9?9/9?9/9999 9?9:99:99 [AP]M"),
    "short": ("999999 999999",),
    "epoch": ("9999999999", "9999999999.9+", "9999999999999", "9999999999999999"),
    "clf": ("9?9/aaa/9999:99:99:99 [-+]9999",),
    "basic": ("99999999T999999", "99999999T999999Z", "99999999T999999[-+]99:?99"),
}


class StampMachine:
    """All templates as one automaton; its states are built when first met and kept."""

    def __init__(self, stamps: dict[str, tuple[str, ...]]):
        self.templates: list[tuple[str, list[tuple[str, str]]]] = []
        for name, patterns in stamps.items():
            for p in patterns:
                self.templates.append((name, self._items(p)))
        start = self._close({(t, 0) for t in range(len(self.templates))})
        self.ids, self.sets, self.accepts, self.table = {start: 0}, [start], [self._accept(start)], [{}]

    @staticmethod
    def _items(pattern: str) -> list[tuple[str, str]]:
        items, i = [], 0
        while i < len(pattern):
            c = pattern[i]
            if c == "[":
                j = pattern.index("]", i + 2)
                c, i = pattern[i + 1 : j], j
            mark = pattern[i + 1] if i + 1 < len(pattern) and pattern[i + 1] in "+?" and pattern[i] != "[" else ""
            items.append((c, mark))
            i += 1 + len(mark)
        return items

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        todo, out = list(states), set()
        while todo:
            t, k = todo.pop()
            if (t, k) in out:
                continue
            out.add((t, k))
            items = self.templates[t][1]
            if k < len(items) and items[k][1] == "?":
                todo.append((t, k + 1))
        return frozenset(out)

    def _accept(self, states: frozenset) -> str | None:
        done = sorted(t for t, k in states if k == len(self.templates[t][1]))
        return self.templates[done[0]][0] if done else None

    def step(self, state: int, c: str) -> int:
        """The next state, -1 for none."""
        kind = "9" if "0" <= c <= "9" else c
        letter = "A" <= c <= "Z" or "a" <= c <= "z"
        new = set()
        for t, k in self.sets[state]:
            items = self.templates[t][1]
            if k < len(items):
                want, mark = items[k]
                if want == kind == "9" or (want == "a" and letter) or (want not in ("9", "a") and c in want):
                    new.add((t, k + 1))
                    if mark == "+":
                        new.add((t, k))
        nxt = -1
        if new:
            closed = self._close(new)
            if closed not in self.ids:
                self.ids[closed] = len(self.sets)
                self.sets.append(closed)
                self.accepts.append(self._accept(closed))
                self.table.append({})
            nxt = self.ids[closed]
        self.table[state][c] = nxt
        return nxt

    def longest(self, text: str, at: int = 0) -> tuple[str, int] | None:
        """Layout and end of the longest time stamp that starts at ``at``."""
        state, found, table, accepts = 0, None, self.table, self.accepts
        for i in range(at, len(text)):
            c = text[i]
            nxt = table[state].get(c)
            state = self.step(state, c) if nxt is None else nxt
            if state < 0:
                break
            if accepts[state]:
                found = accepts[state], i + 1
        return found


class Entry(NamedTuple):
    timestamp: str | None
    level: str
    process: str | None
    component: str | None
    message: str | None


MACHINE = StampMachine(STAMPS)


def _level(word: str | None) -> str:
    return SEVERITY.get((word or "").strip("[]() ").lower(), "")


def _word(s: str, at: int) -> tuple[str, int]:
    """The non-blank run after blanks, and where it ends."""
    n = len(s)
    while at < n and s[at] in " \t":
        at += 1
    end = at
    while end < n and s[end] not in " \t":
        end += 1
    return s[at:end], end


def _bracket(s: str, at: int, opening: str = "[", closing: str = "]") -> tuple[str, int] | None:
    """What the bracket that opens at ``at``, after blanks, holds."""
    n = len(s)
    while at < n and s[at] == " ":
        at += 1
    if at >= n or s[at] != opening:
        return None
    end = s.find(closing, at)
    return None if end < 0 else (s[at + 1 : end], end + 1)


def _tag(s: str, at: int) -> tuple[str, str | None, int] | None:
    """``name(component)[pid]:`` as name, component and end."""
    n = len(s)
    while at < n and s[at] == " ":
        at += 1
    begin = at
    while at < n and s[at] not in " ([:":
        at += 1
    name, component = s[begin:at], None
    if not name:
        return None
    if at < n and s[at] == "(":
        end = s.find(")", at)
        if end < 0:
            return None
        component, at = s[at + 1 : end], end + 1
    if at < n and s[at] == "[":
        end = s.find("]", at)
        if end < 0:
            return None
        at = end + 1
    if at < n and s[at] == " ":  # a version before the colon
        word, end = _word(s, at)
        if word.endswith(":") and word[:1].isdigit():
            at = end - 1
    return (name, component, at + 1) if at < n and s[at] == ":" else None


def pairs(s: str) -> list[tuple[str, str]] | None:
    """key=value pairs from the start of the text; None where it doesn't begin with one."""
    out, i, n = [], 0, len(s)
    while i < n:
        begin = i
        while i < n and (s[i].isalnum() or s[i] in "_.-@"):
            i += 1
        if i == begin or i >= n or s[i] != "=":
            break
        key, i = s[begin:i], i + 1
        if i < n and s[i] in "\"'":
            quote, i, chars = s[i], i + 1, []
            while i < n and s[i] != quote:
                if s[i] == "\\" and i + 1 < n:
                    i += 1
                chars.append(s[i])
                i += 1
            value, i = "".join(chars), i + 1
        else:
            begin = i
            while i < n and s[i] not in " \t":
                i += 1
            value = s[begin:i]
        out.append((key, value))
        while i < n and s[i] in " \t;,":
            i += 1
    return out or None


def json_fields(text: str) -> dict[str, object]:
    """Top-level keys and values of a JSON object; of a damaged one, those that can be read."""
    try:
        got = json.loads(text)
        return got if isinstance(got, dict) else {}
    except ValueError:
        pass
    out: dict[str, object] = {}
    depth, i, n, key, expect = 0, 0, len(text), None, False
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            word = text[i + 1 : j]
            if depth == 1:
                if expect and key is not None:
                    out[key], key, expect = word.encode().decode("unicode_escape", "replace") if "\\" in word else word, None, False
                else:
                    key = word
            i = j
        elif c in "{[":
            depth, key, expect = depth + 1, None, False
        elif c in "}]":
            depth -= 1
            if depth <= 0:
                break
        elif c == ":" and depth == 1:
            expect = True
        elif c == ",":
            key, expect = None, False
        elif depth == 1 and expect and not c.isspace():
            j = i
            while j < n and text[j] not in ",}]\n":
                j += 1
            if key is not None:
                out[key] = text[i:j].strip()
            key, expect, i = None, False, j - 1
        i += 1
    return out


def _from_fields(items: list[tuple[str, object]]) -> Entry:
    got: dict[str, object] = {}
    for k, v in items:
        field = FIELD_OF.get(k.lower())
        if field:
            got[field] = v
    text = {k: None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in got.items()}
    return Entry(text.get("timestamp"), _level(text.get("severity")), text.get("process"), text.get("component"), text.get("message") or "")


def from_json(text: str) -> Entry:
    return _from_fields(list(json_fields(text).items()))


def _syslog_rest(s: str, stamp: str, at: int, level: str = "") -> Entry | None:
    host, at = _word(s, at)
    tag = _tag(s, at)
    if not host or tag is None:
        return Entry(stamp, level, None, None, s[at:].strip()) if host else None
    return Entry(stamp, level, tag[0], tag[1], s[tag[2] :].strip())


def _iso_rest(s: str, stamp: str, at: int) -> Entry:
    rest = s[at:]
    if rest.startswith(" - "):
        parts = rest[3:].split(" - ", 2)
        if len(parts) == 3 and _level(parts[1]):
            return Entry(stamp, _level(parts[1]), parts[0].strip(), None, parts[2])
    b = _bracket(s, at)
    if b is not None and _level(b[0]):
        level, at = _level(b[0]), b[1]
    else:
        word, end = _word(s, at)
        level = _level(word) if word.isupper() else ""
        if level:
            at = end
    if level:
        thread = _bracket(s, at)
        if thread is not None:
            name, end = _word(s, thread[1])
            dash = s.find(" - ", end - 1)
            return Entry(stamp, level, name.rstrip(":") or None, None, s[dash + 3 :] if dash == end else s[end:].lstrip(" -:"))
    tag = _tag(s, at)
    if tag is not None:
        return Entry(stamp, level, tag[0], tag[1], s[tag[2] :].strip())
    if not level:
        as_syslog = _syslog_rest(s, stamp, at)
        if as_syslog is not None and as_syslog.process:
            return as_syslog
    return Entry(stamp, level, None, None, s[at:].strip())


def scan(line: str) -> Entry | str | None:
    """The entry that a line's header begins; "json" where a JSON object begins that other lines end;
    None for a line without a header of its own."""
    s = line.rstrip("\r\n").removeprefix("﻿")
    if not s:
        return None
    c = s[0]
    if c == "{":
        if s.rstrip().endswith("}"):
            try:
                if isinstance(json.loads(s), dict):
                    return from_json(s)
            except ValueError:
                pass
        inner = s[1:].lstrip()
        return "json" if not inner or inner[0] in "\"}" else None
    if c == "<":
        end = s.find(">", 1, 6)
        if end < 2 or not s[1:end].isdigit():
            return None
        level, at = PRIORITY[int(s[1:end]) % 8], end + 1
        version, after = _word(s, at)
        if version.isdigit() and len(version) < 4:
            stamp, after = _word(s, after)
            if stamp == "-" or MACHINE.longest(stamp):
                _, after = _word(s, after)
                app, after = _word(s, after)
                for _ in range(2):
                    _, after = _word(s, after)
                rest = s[after:].strip()
                while rest.startswith("["):  # structured data, quotes may hold brackets
                    i, quoted = 1, False
                    while i < len(rest) and (quoted or rest[i] != "]"):
                        quoted ^= rest[i] == '"' and rest[i - 1] != "\\"
                        i += 1
                    rest = rest[i + 1 :].strip() if i < len(rest) else ""
                return Entry(stamp, level, None if app in ("", "-") else app, None, rest[1:].strip() if rest[:2] in ("-", "- ") else rest)
            return None
        found = MACHINE.longest(s, at)
        return _syslog_rest(s, s[at : found[1]], found[1], level) if found else None
    if c == "[":
        inside = _bracket(s, 0)
        found = MACHINE.longest(inside[0].strip()) if inside else None
        if found is None or found[1] != len(inside[0].strip()):
            return None
        stamp, at = inside[0].strip(), inside[1]
        second = _bracket(s, at)
        if second is None:
            return _iso_rest(s, stamp, at)
        if found[0] == "ctime":
            module, _, level = second[0].rpartition(":")
            at = second[1]
            while (more := _bracket(s, at)) is not None and more[0].startswith(("pid ", "client ")):
                at = more[1]
            return Entry(stamp, _level(level), module or None, None, s[at:].strip())
        return _iso_rest(s, stamp, at)
    found = MACHINE.longest(s)
    if found is not None:
        layout, end = found
        stamp = s[:end]
        if end < len(s) and s[end] not in " \t":
            return None
        if layout == "bsd":
            return _syslog_rest(s, stamp, end)
        if layout == "us":
            source, at = _word(s, end)
            event, at = _word(s, at)
            level, at = _word(s, at)
            if event.isdigit():
                return Entry(stamp, _level(level), source, None, s[at:].strip())
            return _iso_rest(s, stamp, end)
        if layout == "short":
            pid, at = _word(s, end)
            level, at = _word(s, at)
            if not pid.isdigit() or not level:
                return None
            name, at = _word(s, at)
            return Entry(stamp, _level(level), name.rstrip(":") or None, None, s[at:].strip())
        if layout == "epoch" and not s[end:].strip():
            return None
        return _iso_rest(s, stamp, end)
    # a label before a time stamp of digits and a dotted date
    word, at = _word(s, 0)
    if at < len(s) and "=" not in word:
        stamp, after = _word(s, at)
        hit = MACHINE.longest(stamp) if stamp[:1].isdigit() else None
        if hit == ("epoch", len(stamp)):
            fields = s[after:].split(None, 7)
            if len(fields) >= 7 and fields[0][:4].isdigit() and fields[0][4:5] == ".":
                return Entry(stamp, _level(fields[6]), fields[5], None, fields[7] if len(fields) > 7 else "")
        return None
    got = pairs(s) if "=" in word else None
    if got and any(FIELD_OF.get(k.lower()) == "timestamp" and MACHINE.longest(v) for k, v in got):
        return _from_fields(list(got))
    return None


def whole(text: str) -> Entry:
    """Fields of an entry given as one text of one or several lines."""
    lines = text.split("\n")
    head = scan(lines[0])
    if head == "json":
        return from_json(text)
    if head is None:
        return Entry(None, "", None, None, text)
    rest = [x.rstrip("\r") for x in lines[1:]]
    while rest and not rest[-1].strip():
        rest.pop()
    return head._replace(message="\n".join([head.message or "", *rest])) if rest else head


def _closes(text: str) -> bool:
    return text.rstrip("\r ") == "}"


_COLUMNS = ["file_path", "line_number", "last_line", "timestamp", "level", "process", "component", "message", "chunk", "kind", "body"]
_SCHEMA = "file_path string, line_number bigint, last_line bigint, timestamp string, level string, process string, component string, message string, chunk bigint, kind int, body string"
# kinds: 0 done; 1 lines before a chunk's first header; 2 a chunk's last entry


class _Open:
    """The entry being read."""

    def __init__(self, first: int, line: str, head: Entry | str):
        self.first, self.last, self.lines = first, first, [line]
        self.head = head

    def add(self, n: int, line: str) -> None:
        self.lines.append(line)
        if line.strip():
            self.last = n

    def body(self) -> str:
        return "\n".join(self.lines)


def _row(path: str, first: int, last: int, body: str, chunk: int, kind: int) -> tuple:
    e = whole(_trim_json(body))
    return (path, first, last, e.timestamp, e.level, e.process, e.component, e.message, chunk, kind, body if kind else None)


def _trim_json(body: str) -> str:
    """A JSON entry of several lines without the lines that follow its closing brace."""
    lines = body.split("\n")
    if scan(lines[0]) != "json":
        return body
    for i, x in enumerate(lines):
        if i and _closes(x):
            return "\n".join(lines[: i + 1])
    return body


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state: dict = {"key": None}

    def flush(out: list[tuple]) -> None:
        if state["key"] is None:
            return
        path, chunk = state["key"]
        if state["lead"] is not None:
            o = state["lead"]
            out.append((path, None, o.last if o.last >= 0 else None, None, None, None, None, None, chunk, 1, o.body()))
        if state["open"] is not None:
            o = state["open"]
            out.append(_row(path, o.first, o.last, o.body(), chunk, 2))

    for pdf in batches:
        out: list[tuple] = []
        for path, chunk, n, line in zip(pdf["file_path"], pdf["chunk"], pdf["line_number"], pdf["line"], strict=True):
            if (path, chunk) != state["key"]:
                flush(out)
                state = {"key": (path, chunk), "lead": None, "open": None, "seen": None}
            if n == state["seen"]:
                continue
            state["seen"] = n
            line = (line or "").rstrip("\r\n")
            head = scan(line)
            if head is not None:
                o = state["open"]
                if o is not None:
                    out.append(_row(path, o.first, o.last, o.body(), chunk, 0))
                state["open"] = _Open(n, line, head)
            elif state["open"] is not None:
                state["open"].add(n, line)
            else:
                if state["lead"] is None:
                    state["lead"] = _Open(n, line, "")
                    state["lead"].last = n if line.strip() else -1
                else:
                    state["lead"].add(n, line)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"line_number": "Int64", "last_line": "Int64"})
    out = []
    flush(out)
    if out:
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"line_number": "Int64", "last_line": "Int64"})


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open entries of one chunk with the headerless lines of the next ones; finished ones pass by."""
    held: list | None = None  # path, first line, last line, bodies

    def done(h: list) -> tuple:
        return _row(h[0], h[1], h[2], "\n".join(h[3]), 0, 0)

    for pdf in batches:
        out: list[tuple] = []
        for r in pdf[pdf["kind"] > 0].itertuples(index=False):
            if held is not None and (r.kind == 2 or r.file_path != held[0]):
                out.append(done(held))
                held = None
            if r.kind == 2:
                held = [r.file_path, int(r.line_number), int(r.last_line), [r.body]]
            elif held is not None:
                held[2] = held[2] if pd.isna(r.last_line) else int(r.last_line)
                held[3].append(r.body)
        yield pdf[pdf["kind"] == 0]
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"line_number": "Int64", "last_line": "Int64"})
    if held is not None:
        yield pd.DataFrame([done(held)], columns=_COLUMNS).astype({"line_number": "Int64", "last_line": "Int64"})


def entries_of_lines(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(file_path, line_number, last_line, timestamp, level, process, component, message), one row per entry.

    ``lines`` has file_path, line_number and line, in any order; other columns are ignored. Lines
    delivered again count once; a null line is a blank one; rows without a file or line number, and
    lines before a file's first entry, belong to no entry. ``level`` is '' and other fields null where
    the layout has none. A message holds its continuation lines, without blank lines at its end. A task
    holds one entry at a time, as its row does.
    """
    src = lines.select("file_path", F.col("line_number").cast("bigint").alias("line_number"), "line").dropna(subset=["file_path", "line_number"])
    src = src.withColumn("chunk", F.floor(F.col("line_number") / chunk).cast("bigint"))
    parts = src.repartition("file_path", "chunk").sortWithinPartitions("file_path", "chunk", "line_number").mapInPandas(_chunks, _SCHEMA)
    # what chunks leave open meets by file, what is finished is spread by chunk, so the lines are scanned once
    meet = F.when(F.col("kind") > 0, -1).otherwise(F.col("chunk"))
    return parts.repartition("file_path", meet).sortWithinPartitions("file_path", "chunk", "kind").mapInPandas(_merge, _SCHEMA).drop("chunk", "kind", "body")


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, n, text in zip(pdf["file_path"], pdf["line_number"], pdf["text"], strict=True):
            body = text or ""
            lines = body.split("\n")
            while len(lines) > 1 and not lines[-1].strip():
                lines.pop()
            out.append(_row(path, n, n + len(lines) - 1, body, 0, 0)[:8])
        yield pd.DataFrame(out, columns=_COLUMNS[:8]).astype({"line_number": "Int64", "last_line": "Int64"})


def entries_of_texts(records: DataFrame, text: str) -> DataFrame:
    """The same columns for records that each hold one entry's text; a record delivered again counts once."""
    src = records.select("file_path", F.col("line_number").cast("bigint").alias("line_number"), F.col(text).alias("text")).dropna(subset=["file_path", "line_number"]).dropDuplicates(["file_path", "line_number"])
    return src.mapInPandas(_texts, _SCHEMA.split(", chunk")[0])
