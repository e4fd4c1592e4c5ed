"""Secret scans with corpus-wide ownership frequency.

Base patterns find assignments, access keys and long hexadecimal runs in whole texts. The method
adds the long mixed tokens that no base pattern names: their hashes are counted over distinct
repositories and owners of the whole corpus. A token that several owners hold is a widely copied
example and is left alone; one that a single owner holds in few repositories looks live and becomes a
span of its own kind (``owned``). Base spans always stay; their values are counted as well, so every occurrence of a
token tells of its owners, whether it stands bare or in an assignment.

Null texts are empty. A null repository or owner counts as one unnamed repository or owner. Repeated
rows are scanned each for itself and count once for their owner. Extra columns are ignored.
"""

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brevis.llm.common import store

#: Kinds in the order in which ties of a start are listed.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

SPAN = "array<struct<kind:int,start:int,end:int>>"
CANDIDATE = "array<struct<hash:binary,start:int,end:int>>"


def base_spans(text: str) -> list:
    """(kind, start, end) by start, then kind; offsets in code points, end exclusive."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in map(token.count, set(token)))


def candidates(text: str, base: list, least_bits: float = 3.5) -> list:
    """(hash, start, end) of long random-looking tokens outside the base spans."""
    out = []
    for m in TOKEN.finditer(text):
        t = m[0]
        if not (any("0" <= c <= "9" for c in t) and any(c.isalpha() for c in t)) or entropy(t) < least_bits:
            continue
        if not any(s < m.end() and m.start() < e for _, s, e in base):
            out.append((hashlib.blake2b(t.encode(), digest_size=16).digest(), m.start(), m.end()))
    return out


def held_values(text: str, base: list) -> list:
    """Hashes of the values of base spans, and of the long random-looking tokens in them or touching them."""
    values = set()
    for kind, s, e in base:
        value = ASSIGN.fullmatch(text, s, e)[2] if kind == 0 else text[s:e]
        values |= {value, *(m[0] for m in TOKEN.finditer(value))}
    values |= {m[0] for m in TOKEN.finditer(text) if any(s < m.end() and m.start() < e for _, s, e in base)} if base else set()
    return [hashlib.blake2b(v.encode(), digest_size=16).digest() for v in sorted(values)]


def scan(docs: DataFrame, keep: list, text: str = "text") -> DataFrame:
    """``keep`` columns with ``base`` spans, ``tokens``, the candidates of each row, and ``held``, hashes of its base values."""
    slim = docs.select(*keep, F.col(text).alias("_text"))
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    hashes = pa.list_(pa.struct([("hash", pa.binary()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            base, found, held = [], [], []
            for t in b.column("_text").to_pylist():
                spans = base_spans(t or "")
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                found.append([{"hash": h, "start": s, "end": e} for h, s, e in candidates(t or "", spans)])
                held.append(held_values(t or "", spans))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(base, kinds), pa.array(found, hashes), pa.array(held, pa.list_(pa.binary()))],
                [*keep, "base", "tokens", "held"])

    typed = slim.select(*keep, F.lit(None).cast(SPAN).alias("base"), F.lit(None).cast(CANDIDATE).alias("tokens"), F.lit(None).cast("array<binary>").alias("held"))
    return slim.mapInArrow(run, typed.schema)


def ownership(scanned: DataFrame, repository: str, owner: str) -> DataFrame:
    """hash, repositories, owners: distinct counts over the corpus.

    Both are reduced to distinct (hash, owner, repository) before the shuffle, so a token that
    fills the corpus costs one row per task, owner and repository.
    """
    every = F.explode(F.concat("tokens.hash", "held"))
    seen = scanned.select(F.col(repository).alias("_r"), F.col(owner).alias("_o"), every.alias("hash")).distinct()
    per_owner = seen.groupBy("hash", "_o").agg(F.count("*").alias("n"))
    return per_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def find(
    docs: DataFrame, repository: str = "source", owner: str = "source", text: str = "text", keep: tuple = ("doc_id",),
    most_owners: int = 1, most_repositories: int = 3,
) -> DataFrame:
    """``keep`` columns with ``base`` and ``spans`` (base and owned spans by start, then kind) per row.

    The scanned table holds spans only: nothing but candidate hashes is shuffled by hash, nothing but span
    lists by row, and texts stay in the scan.
    """
    source = docs.select(
        *keep, F.col(repository).alias("_repo"), F.col(owner).alias("_own"), F.col(text).alias("_body"),
    ).withColumn("_row", F.expr("uuid()"))
    scanned = store(scan(source, [*keep, "_repo", "_own", "_row"], "_body"), "secrets")
    owned = ownership(scanned, "_repo", "_own").where(
        (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).select("hash")
    added = (
        scanned.select("_row", F.explode("tokens").alias("t"))
        .select("_row", "t.hash", F.struct(F.lit(3).alias("kind"), "t.start", "t.end").alias("span"))
        .join(owned, "hash")
        .groupBy("_row").agg(F.collect_list("span").alias("_added"))  # bounded by one text
    )
    every = F.concat("base", F.coalesce("_added", F.array().cast(SPAN)))
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return scanned.join(added, "_row", "left").select(*keep, "base", ordered.alias("spans"))


def listed(spans) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: str, spans: list) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, repository: str = "source", owner: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every base and owned span of its texts replaced.

    Base spans are found again next to the text; only the owned ones come from elsewhere, keyed by
    the row's key and the hash of its text. Null texts stay null.
    """
    named = docs.columns
    plain = [f"c{i}" for i in range(len(named))]
    body, own = plain[named.index(text)], plain[named.index(key)]
    rows = docs.toDF(*plain).withColumn("sign", F.xxhash64(F.col(body)))
    found = find(
        rows, plain[named.index(repository)], plain[named.index(owner)], body, keep=(own, "sign"))
    # Equal keys with equal texts have equal owned spans.
    added = found.select(F.col(own).alias("k"), F.col("sign").alias("s"), F.filter("spans", lambda x: x["kind"] == 3).alias("added")).where(
        F.size("added") > 0).groupBy("k", "s").agg(F.first("added").alias("added"))
    both = rows.join(added, rows[own].eqNullSafe(added["k"]) & (rows["sign"] == added["s"]), "left").select(*plain, "added")
    out = both.select(*plain).schema

    def run(batches):
        for b in batches:
            texts = []
            for t, extra in zip(b.column(body).to_pylist(), b.column("added").to_pylist(), strict=True):
                spans = [(s, k, e) for k, s, e in base_spans(t or "")] + [(x["start"], x["kind"], x["end"]) for x in extra or []]
                texts.append(redact(t, spans) if spans else t)
            changed = pa.array(texts, b.column(body).type)
            yield pa.RecordBatch.from_arrays([changed if c == body else b.column(c) for c in plain], plain)

    return both.mapInArrow(run, out).toDF(*named)
