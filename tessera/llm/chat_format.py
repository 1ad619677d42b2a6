"""Chat formatting by schema fingerprints.

Records of many layouts come as JSON text. A record's fingerprint is the hash of its
sorted nested field paths with their kinds (list elements share a path); a table of
declarative mappings says, per fingerprint, where turns, roles and texts lie. A layout
with optional fields has one entry per combination. Records of an unknown fingerprint are
returned with an error and never guessed at.

Canonical turns are (role, text). The template writes

    <s>  then per turn  [INST]role: text[/INST]      for every role but assistant
                   or   [ASST]text</s>               for the assistant

Control strings inside roles and texts are made harmless by writing every ``<`` as ``<0``,
``[`` as ``[0`` and (in roles only) ``:`` as ``<1``, which is undone exactly. The loss mask is the list of
offsets of the assistants' texts in the formatted string.

Defined results: null texts and roles count as empty; turns that share a number go by
role, then text; a conversation without turns gives no row; repeated rows are turns of
their own. A conversation is one formatted string, so all its turns meet in one row.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

BEGIN, USER_OPEN, USER_CLOSE, ASST_OPEN, ASST_CLOSE = "<s>", "[INST]", "[/INST]", "[ASST]", "</s>"
ASSISTANT = "assistant"


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths with the kind of their value."""
    if isinstance(value, dict):
        out = {f"{at}{{}}"}
        for k, v in value.items():
            out |= field_paths(v, f"{at}.{k}")
        return out
    if isinstance(value, list):
        out = {f"{at}[]"}
        for v in value:
            out |= field_paths(v, f"{at}[]")
        return out
    return {f"{at}:{'string' if isinstance(value, str) or value is None else 'scalar'}"}


def fingerprint(record) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths(record))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Either a list of messages (``messages``, ``role``, ``text``; ``roles`` renames), or single
    fields in order: (field, role); fields that are missing or empty by default are listed in ``optional``."""
    name: str
    messages: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, str], ...] = ()

    def example(self):
        if self.messages:
            return {self.messages: [{self.role: "", self.text: ""}]}
        return {f: "" for f, _ in self.fields}

    def turns(self, record) -> list[tuple[str, str]]:
        if self.messages:
            rename = dict(self.roles)
            return [(rename.get(m.get(self.role) or "", m.get(self.role) or ""), m.get(self.text) or "")
                    for m in record[self.messages]]
        return [(role, record.get(f) or "") for f, role in self.fields]


MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("conversations", "conversations", "from", "value", (("human", "user"), ("gpt", ASSISTANT))),
    Mapping("turns", "turns", "speaker", "utterance"),
    Mapping("prompt_response", fields=(("prompt", "user"), ("response", ASSISTANT))),
    Mapping("instruction", fields=(("instruction", "user"), ("output", ASSISTANT))),
    Mapping("instruction_system", fields=(("system", "system"), ("instruction", "user"), ("output", ASSISTANT))),
)


def registry(mappings=MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(m.example()): m for m in mappings}


_OUT = re.compile(r"[<\[]")
_BACK = re.compile(r"[<\[]0")


def escape(text: str) -> str:
    return _OUT.sub(lambda m: m[0] + "0", text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[0][0], text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "<1")


def unescape_role(role: str) -> str:
    return unescape(role.replace("<1", ":"))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted string and loss mask (code-point offsets, end exclusive)."""
    out, mask, n = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        body = escape(text)
        if role == ASSISTANT:
            mask.append((n + len(ASST_OPEN), n + len(ASST_OPEN) + len(body)))
            piece = f"{ASST_OPEN}{body}{ASST_CLOSE}"
        else:
            piece = f"{USER_OPEN}{escape_role(role)}: {body}{USER_CLOSE}"
        out.append(piece)
        n += len(piece)
    return "".join(out), mask


_TURN = re.compile(r"\[INST\]([^:]*): (.*?)\[/INST\]|\[ASST\](.*?)</s>", re.S)


def parse_formatted(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted string; raises if it holds anything else."""
    if not text.startswith(BEGIN):
        raise ValueError("no begin mark")
    at, turns = len(BEGIN), []
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("malformed turn")
        turns.append((ASSISTANT, unescape(m[3])) if m[3] is not None else (unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


FORMATTED = "layout string, formatted string, mask array<struct<first:int,last:int>>, error string"


def _format_batch(records: pd.Series) -> pd.DataFrame:
    known, rows = registry(), []
    for raw in records:
        try:
            value = json.loads(raw)
            m = known.get(fingerprint(value))
            if m is None:
                rows.append((None, None, None, "unknown layout " + fingerprint(value)))
                continue
            text, mask = format_turns(m.turns(value))
            rows.append((m.name, text, [{"first": a, "last": b} for a, b in mask], None))
        except (TypeError, ValueError) as e:
            rows.append((None, None, None, f"not a record: {e}"[:200]))
    return pd.DataFrame(rows, columns=["layout", "formatted", "mask", "error"])


DIGESTS = ("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _read_batch(formatted: pd.Series, mask: pd.Series) -> pd.DataFrame:
    rows = []
    for text, spans in zip(formatted, mask):
        if text is None:                            # a record that was not formatted
            rows.append((None,) * 5)
            continue
        turns = parse_formatted(text)
        loss = "".join(unescape(text[s["first"]:s["last"]]) for s in spans)
        rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGESTS.split(", ")])


def read_back(formatted: Column, mask: Column) -> Column:
    """Struct of DIGESTS: what the formatted strings and their masks hold (nulls for a null string)."""
    return pandas_udf(_read_batch, DIGESTS)(formatted, mask)


def format_records(records: DataFrame, *, json_col: str = "record") -> DataFrame:
    """``records`` with layout, formatted, mask and error in a struct column ``chat``, which replaces one of that name."""
    return records.withColumn("chat", pandas_udf(_format_batch, FORMATTED)(F.coalesce(F.col(json_col), F.lit(""))))


def as_records(turns: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as JSON records of the known layouts: a
    user and an assistant turn become prompt/response or instruction records (with a leading system turn: with
    system), all others message lists; which of them goes by the id."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    roles = F.expr("transform(m, x -> x.role)")
    odd = F.pmod(F.col("conv_id"), F.lit(3))
    text = lambda i: F.col("m")[i]["text"]
    plain = ~F.exists("m", lambda x: x["role"].isin("human", "gpt"))       # names that the second layout gives a meaning
    listed = (F.when(plain & (odd == 1), F.to_json(F.struct(F.expr(
        "transform(m, x -> named_struct('from', case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end, 'value', x.text))")
        .alias("conversations"))))
        .when(odd == 2, F.to_json(F.struct(F.expr("transform(m, x -> named_struct('speaker', x.role, 'utterance', x.text))").alias("turns"))))
        .otherwise(F.to_json(F.struct(F.expr("transform(m, x -> named_struct('role', x.role, 'content', x.text))").alias("messages")))))
    pair = roles == F.array(F.lit("user"), F.lit(ASSISTANT))
    led = roles == F.array(F.lit("system"), F.lit("user"), F.lit(ASSISTANT))
    record = (F.when(pair & (odd == 0), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
              .when(pair & (odd == 1), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
              .when(led & (odd == 0), F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
              .otherwise(listed))
    return c.select("conv_id", record.alias("record"))
