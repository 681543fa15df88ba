"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them.

Patterns find protected entities (addresses, numbers). For each entity and each term within WINDOW words of
it the corpus tells how often they meet. The disclosure of a term is its pointwise mutual information with
the entity over the entity's information content, 1 + log P(entity | term) / IC(entity): at 1 the term gives
the entity away. Terms above REMOVE are removed, above GENERALISE replaced by their class; both only near
the entity, so a document without personal data never changes. Counts are numbers of documents, over all
documents; a pair must meet in SUPPORT documents before anything can be said about it.

A term is a run of Unicode letters, near an entity and in the counts alike; an entity also ends the run beside it.

Only thin rows are shuffled: one per (entity, term) met in a document. A null text is empty and has no
spans. Rows that repeat doc_id and text are one document in the counts.

An empty table gives an empty result; repeated rows are handled one by one, as rows of equal texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.hashing import LETTER, range_hashes, runs, word_spans
from commitloom.llm.tables import per_batch, stored, texts

WINDOW = 8
SUPPORT = 3
GENERALISE, REMOVE = 0.7, 0.9
KINDS = ("email", "ip", "card", "phone")
#: Bits of the filter of candidate terms that all tasks get: a fixed size, beyond which it only filters less.
FILTER_BITS = 1 << 23
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that begins inside a run of digits would also begin at its start
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
#: Beyond ASCII, what no term holds.
_BETWEEN = re.compile(r"(?![\x00-\x7F])[\W\d_]")
_APART = np.ones(256, bool)
_APART[65:91] = _APART[97:123] = _APART[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_AZ = {i: i + 32 for i in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    out, end = [], 0
    for match in _DOMAIN.finditer(text):
        start = match.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            out.append(("email", start, match.end()))
            end = match.end()
    return out


def entities(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end), by kind as listed and then by start."""
    out = _emails(text) if "@" in text else []
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
        for match in _CARD.finditer(text):
            digits = match.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *match.span()))
        if "+" in text:
            for match in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(match.group())) <= 15:
                    out.append(("phone", *match.span()))
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _parted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with runs of letters ended as ``nearby`` ends them: bytes from 128 on are left in letters only.

    Of the entities only addresses can touch a letter, and only one beyond ASCII.
    """
    if not len(data) or data.max() < 128:
        return data, offsets
    raw, out = data.tobytes(), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        piece = raw[a:b]
        if not piece.isascii():
            text = piece.decode()
            if "@" in text:
                cuts = [0, *(x for _, start, end in _emails(text) for x in (start, end)), len(text)]
                text = " ".join(text[x:y] for x, y in zip(cuts, cuts[1:]))
            piece = _BETWEEN.sub(" ", text).encode()
        out.append(piece)
    return np.frombuffer(b"".join(out), np.uint8), np.cumsum([0, *map(len, out)])


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of letters (A-Z lowered) and the text it stands in."""
    data, offsets = _parted(data, offsets)
    lowered = _LOWER[data]
    starts, ends, text = word_spans(lowered, offsets, _APART)
    return range_hashes(LETTER[lowered], starts, ends).view(np.int64), text


def _term_hash(term: str) -> int:
    data = np.frombuffer(term.translate(_AZ).encode(), np.uint8)
    return int(range_hashes(LETTER[data], np.array([0]), np.array([len(data)])).view(np.int64)[0])


def nearby(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """(entity, term, start, end) of the terms within WINDOW words of a base span, outside all base spans."""
    inside: list[list[int]] = []  # the base spans, merged where they overlap
    for a, b in sorted((a, b) for _, a, b in spans):
        if inside and a < inside[-1][1]:
            inside[-1][1] = max(inside[-1][1], b)
        else:
            inside.append([a, b])
    starts, ends = [a for a, _ in inside], [b for _, b in inside]
    out = []
    for kind, start, end in spans:
        value = text[start:end].lower() if kind == "email" else "".join(_DIGITS.findall(text[start:end]))
        entity = _hash(f"{kind}:{value}")
        for term in [*_before(text, start), *_after(text, end)]:
            a, b = term
            at = bisect_right(ends, a)  # the first span that ends after the term begins
            if at == len(ends) or starts[at] >= b:
                out.append((entity, _term_hash(text[a:b]), a, b))
    return out


def _edges(text: str, place: int, step: int) -> int:
    """Where WINDOW words lie between ``place`` and the result, going by ``step``."""
    seen, apart = 0, True
    while 0 <= place - (step < 0) < len(text) and seen <= WINDOW:
        space = text[place - (step < 0)].isspace()
        seen += apart and not space
        apart = space
        if seen > WINDOW:
            break
        place += step
    return place


def _before(text: str, start: int) -> Iterator[tuple[int, int]]:
    low = _edges(text, start, -1)
    return ((low + m.start(), low + m.end()) for m in _TERM.finditer(text[low:start]))


def _after(text: str, end: int) -> Iterator[tuple[int, int]]:
    return ((end + m.start(), end + m.end()) for m in _TERM.finditer(text[end:_edges(text, end, 1)]))


_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))


def detected(docs: DataFrame) -> DataFrame:
    """Base counts, base spans and the terms near them, for every row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text"):
            text = text.as_py()
            spans = entities(text)
            counts = [sum(1 for s in spans if s[0] == kind) for kind in KINDS]
            rows.append((*counts, ",".join(f"{k}:{a}:{b}" for k, a, b in spans), nearby(text, spans) if spans else [], _hash(text) if spans else 0))
        n = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        near = pa.array([[dict(zip(("entity", "term", "start", "end"), x)) for x in r[5]] for r in rows], _NEAR)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *n, pa.array([r[4] for r in rows]), near, pa.array([r[6] for r in rows], pa.int64())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "near", "text_hash"])

    return texts(docs).mapInArrow(
        per_batch(step),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, near array<struct<entity:long,term:long,start:int,end:int>>, text_hash long")


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_term): how many documents hold each term of ``wanted``, over all documents."""
    place = wanted.select(F.pmod("term", F.lit(FILTER_BITS)).cast("int").alias("place"))
    words = place.select(F.expr("place div 64").cast("int").alias("at"), F.expr("shiftleft(1L, place % 64)").alias("bit"))
    rows = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[rows["at"]] = rows["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for first, data, offsets in runs(batch.column("text")):
            terms, owner = term_hashes(data, offsets)
            asked = shared.value[terms % FILTER_BITS]
            pairs = np.unique(np.stack([terms[asked], owner[asked] + first], axis=1), axis=0)
            found.append(pairs[:, 0])
        terms, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], names=["term", "n"])

    counted = texts(docs).mapInArrow(per_batch(step), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted.join(wanted.select("term").distinct(), "term")


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of the pairs that meet in SUPPORT documents or more."""
    once = found.where(F.size("near") > 0).dropDuplicates(["doc_id", "text_hash"])
    met = once.select(F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))).alias("x")).select("x.*")
    pairs = stored(met.groupBy("entity", "term").agg(F.count("*").alias("n_pair")).where(F.col("n_pair") >= SUPPORT))
    own = once.select(F.explode(F.array_distinct("near.entity")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    total = float(max(2, docs.count()))
    content = F.log2(F.lit(total) / F.col("n_entity"))
    value = F.when(content > 0, 1 + F.log2(F.least(F.lit(1.0), F.col("n_pair") / F.col("n_term"))) / content)
    return pairs.join(own, "entity").join(term_counts(docs, pairs), "term").select("entity", "term", value.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, the four counts, base and spans (base and added ones)."""
    found = stored(detected(docs))
    told = disclosures(docs, found)
    near = found.where(F.size("near") > 0).select("doc_id", "text_hash", F.explode("near").alias("x")).select("doc_id", "text_hash", "x.*")
    added = (
        near.join(told, ["entity", "term"])
        .groupBy("doc_id", "text_hash", "start", "end").agg(F.max("disclosure").alias("disclosure"))
        .select("doc_id", "text_hash", F.struct(F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise").alias("kind"), "start", "end").alias("span"))
        .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("span")).alias("added")))  # within one document
    added = added.withColumnsRenamed({"doc_id": "own", "text_hash": "own_hash"})
    listed = F.array_join(F.transform("added", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return (
        found.join(added, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("own_hash")), "left")
        .withColumn("spans", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("added") > 0, listed)))
        .select("doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and text with entities and generalised terms replaced by their class, disclosing terms removed."""
    spans = personal_data(docs).where(F.col("spans") != "").select(F.col("doc_id").alias("own"), "text_hash", "spans").distinct()

    @F.pandas_udf("string")
    def rewrite(text, spans):  # type: ignore[no-untyped-def]
        return text.combine(spans, lambda t, s: t if s is None else masked(t, s))

    @F.pandas_udf("long")
    def hashed(text):  # type: ignore[no-untyped-def]
        return text.map(_hash)

    given = texts(docs).withColumn("hash", hashed("text"))
    return given.join(spans, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("hash") == F.col("text_hash")), "left").select("doc_id", rewrite("text", "spans").alias("text"))


def masked(text: str, spans: str) -> str:
    out, end = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(","))), key=lambda s: (s[1], -s[2])):
        if b > end:
            out.append(text[end:max(a, end)])
            out.append("" if kind == "remove" else "[TERM]" if kind == "generalise" else f"[{kind.upper()}]")
            end = b
    return "".join(out) + text[end:]
