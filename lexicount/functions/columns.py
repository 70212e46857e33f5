"""Column expressions (all built-in, codegen-friendly; no Python per row)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace class shared with the SQL oracle; `\s` differs between engines.
WS_TOKEN = r"[^ \t\n\r]+"
WS_RUN = r"[ \t\n\r]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whitespace_tokens(text: str | Column) -> Column:
    """Number of whitespace-separated tokens (NULL text -> 0)."""
    return F.coalesce(F.regexp_count(col(text), F.lit(WS_TOKEN)), F.lit(0)).cast("long")



def token_count(c: str | Column) -> Column:
    """Missing token count -> 0."""
    return F.coalesce(col(c).cast("long"), F.lit(0).cast("long"))


def map_literal(m: Mapping, value_type: str | None = None) -> Column:
    """Literal MapType column from a small Python dict (a parameter, not data)."""
    items = []
    for k, v in m.items():
        items += [F.lit(k), F.lit(v)]
    out = F.create_map(*items)
    return out.cast(f"map<string,{value_type}>") if value_type else out



def text_head(text: str | Column, n: int = 200, newline_marker: str = "\\n") -> Column:
    """First ``n`` characters with newlines shown as a marker."""
    return F.regexp_replace(F.substring(col(text), 1, n), "\n", newline_marker.replace("\\", "\\\\"))


def order_key(seed: int | Column, epoch: str | Column, doc_id: str | Column) -> Column:
    """Seeded per-epoch order key, md5('seed|epoch|doc_id'); same in any engine."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", s.cast("string"), col(epoch).cast("string"),
                             col(doc_id).cast("string")))


def key_bucket(key: str | Column, hex_chars: int = 3) -> Column:
    """Leading hex characters of an md5 key as an int (monotone in the key)."""
    return F.conv(F.substring(col(key), 1, hex_chars), 16, 10).cast("int")


def alias_depth(alias: str | Column) -> Column:
    """depth = number of leading spaces of the alias."""
    a = col(alias)
    return (F.length(a) - F.length(F.ltrim(a))).cast("int")


def task_lang(task: str | Column, langs: Sequence[str] = ("eng", "nld", "zho")) -> Column:
    """First language code contained in the task name, else NULL."""
    t = col(task)
    out = None
    for lg in langs:
        cond = t.contains(lg)
        out = F.when(cond, F.lit(lg)) if out is None else out.when(cond, F.lit(lg))
    return out.otherwise(F.lit(None).cast("string"))


def task_lang_strict(task: str | Column, mapping: Mapping[str, str]) -> Column:
    """P08 strict mode: dictionary lookup of the whole task name."""
    return F.element_at(map_literal(mapping, "string"), col(task))


def revision_to_int(rev: str | Column) -> Column:
    """``chck_(\\d+)M`` -> int, anything else -> -1."""
    r = col(rev)
    return F.when(r.rlike(r"^chck_\d+M$"),
                  F.regexp_extract(r, r"^chck_(\d+)M$", 1).cast("int")).otherwise(F.lit(-1))


def milestone_name(tokens: str | Column) -> Column:
    """P10: milestone -> ``chck_{max(1, ceil(N / 1e6))}M``."""
    m = F.greatest(F.ceil(col(tokens) / F.lit(1_000_000)), F.lit(1))
    return F.concat(F.lit("chck_"), m.cast("string"), F.lit("M"))


def lang2(lang3: str | Column, mapping: Mapping[str, str] | None = None) -> Column:
    """3-letter -> 2-letter language code."""
    from ..config import LANG_3_TO_2
    return F.element_at(map_literal(mapping or LANG_3_TO_2, "string"), col(lang3))


def canonical_task(task: str | Column, aliases: Mapping[str, str]) -> Column:
    """Canonical task name through an alias map (unknown names pass through)."""
    return F.coalesce(F.element_at(map_literal(aliases, "string"), col(task)), col(task))


def model_key(repo: str | Column) -> Column:
    """``org/model`` -> ``org__model``."""
    return F.replace(col(repo), F.lit("/"), F.lit("__"))
