"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they match: assignments to secret-like names, access key identifiers, long hexadecimal
runs. Weaker parts - identifiers, opaque tokens, endpoints - say little alone; they are reported only where complementary
parts stand in one scope. Scopes are blocks of lines (an empty line ends one); inside a scope the parts are joined by
interval: any two that do not overlap are linked, or, where a caller gives a reach, those with a gap of so many code points at
most.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: The end of a scope: an empty line.
_SCOPE_END = re.compile(r"\n[ \t\r]*\n")

# Fixed patterns of the contract, in the order of its kinds. A run of 24 or more hexadecimal digits is the same set of matches
# as all runs of which the shorter ones are dropped.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
# Weak parts: who (an identifier of an account), what (an opaque token), where (an endpoint).
# An address is read from the start of its run of letters, so no run is read twice, however long it is.
_WHO = re.compile(r"""(?<![A-Za-z0-9._%+-])[.%+-]*+(?P<mail>[A-Za-z0-9_][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)|\b(?:user(?:name|id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,}+)""", re.IGNORECASE | re.ASCII)
_WHAT = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
_WHERE = re.compile(r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?\b""", re.ASCII)
KINDS = (*BASE, "who", "what", "where")
_RANK = {k: i for i, k in enumerate(KINDS)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong patterns, in code points, in reported order."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], _RANK[s[2]]))


def opaque(token: str) -> bool:
    """Upper and lower case or letters and digits, well mixed, as in generated secrets."""
    upper, lower, digits = (sum(map(f, token)) for f in (str.isupper, str.islower, str.isdigit))
    return digits >= 3 and upper + lower >= 6 and (min(upper, lower) >= 3 or digits * 4 >= len(token))


def furthest(spans: list[tuple[int, int]]) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Starts in order, and for each the two different spans so far that end last."""
    starts, ends, best = [], [], []
    for span in sorted(spans):
        best = sorted({*best, span}, key=lambda s: (-s[1], s[0]))[:2]
        starts.append(span[0])
        ends.append(best)
    return starts, ends


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int | None = None) -> list[tuple[int, int, str]]:
    """The weak parts that stand with complementary parts in their scope.

    An identifier (`who`) and an endpoint (`where`) need a secret: a strong span other than an access key, or a weak token.
    A weak token (`what`) needs an identifier (`who` or an access key) or an endpoint. Weak spans that overlap strong ones are
    not reported.
    """
    weak = [(m.start(), m.end(), "what") for m in _WHAT.finditer(text) if opaque(m.group())]
    if not base and not weak:
        return []
    weak += [(max(m.start(), m.start("mail")), m.end(), "who") for m in _WHO.finditer(text)]
    weak += [(m.start(), m.end(), "where") for m in _WHERE.finditer(text)]
    ends: list[int] = []
    for s in sorted(base):
        ends.append(max(s[1], ends[-1] if ends else 0))
    begins = sorted(s[0] for s in base)
    free = [w for w in weak if not (k := bisect_left(begins, w[1])) or ends[k - 1] <= w[0]]
    if not free:
        return []
    apart = len(text) if reach is None else reach
    scopes = [m.start() for m in _SCOPE_END.finditer(text)]
    sides: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for start, end, kind in [*base, *free]:
        side = {"access": "who", "assign": "what", "hex": "what"}.get(kind, kind)
        sides.setdefault((side, bisect_right(scopes, start)), []).append((start, end))
    reaching = {key: furthest(spans) for key, spans in sides.items()}

    def near(span: tuple[int, int, str], side: str) -> bool:
        """Whether a span of the side other than this one lies in its scope, `apart` away at most."""
        starts, ends = reaching.get((side, bisect_right(scopes, span[0])), ([], []))
        k = bisect_right(starts, span[1] + apart)
        return k > 0 and any(e >= span[0] - apart and (s, e) != span[:2] for s, e in ends[k - 1])

    needs = {"who": lambda w: near(w, "what"), "what": lambda w: near(w, "who") or near(w, "where"), "where": lambda w: near(w, "what")}
    return [w for w in free if needs[w[2]](w)]


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """id and spans array<struct<start, end, kind, base>> of every row, by start, then by kind as listed in KINDS.

    Positions are code points, ends exclusive. A null or empty text has no spans; texts are scanned whole. Repeated rows give
    repeated results; other columns are ignored. No shuffle; the time of a text is linear in its length, but for sorting its spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in (linked_spans(text, base, reach) if text else [])], key=lambda s: (s[0], _RANK[s[2]]))
                out.append([{"start": s, "end": e, "kind": k, "base": b} for s, e, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], [id_col, "spans"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, spans array<struct<start: bigint, end: bigint, kind: string, base: boolean>>")


def op5_secrets(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = named(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *map(of, BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
