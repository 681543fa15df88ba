"""Each operator against a plain computation of its result, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sentences(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    passage = " ".join(_sentences(rng, 60))
    out = []
    for i in range(40):
        words = _sentences(rng, rng.randint(30, 120))
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage.split()
        out.append(" ".join(words))
    near = out[1].split()
    near[5] = "changed"
    out += [out[1], out[1].upper(), " ".join(near), out[3], "", None, "x " * 90, "short text", "é ü 漢字 " * 60, "a" * 700, out[5] + "\n" + out[5]]
    out.append(" ".join(_sentences(rng, 6000)))
    table = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 5}", 0, 0.5, "x", 1) for i, t in enumerate(out)]
    return [*table, table[2], (100, out[2], "en", "s1", 0, 0.5, "x", 1)]  # a repeated row, a copy under another id


@pytest.fixture(scope="module")
def docs(spark, rows):
    from commitloom.llm.tables import stored

    return stored(spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_licences(docs, empty, spark):
    from commitloom.llm import licenses as L

    assert L.licences(empty).count() == 0
    mit = L.TEMPLATES["mit-text"]
    texts = ["Released under the MIT license!", "a\n" + mit.replace(" to ", "\nto ") + "\nend", "released under", None, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."]
    found = {r.doc_id: r for r in L.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i].licence for i in range(5)] == ["mit", "mit-text", None, None, "cc-by-nc-4.0"]

    def plain(text):
        lines = [L.words(x) for x in (text or "").split("\n")]
        best = None
        for i, j in itertools.combinations_with_replacement(range(len(lines)), 2):
            if lines[i] and lines[j]:
                block = L.bigrams([w for line in lines[i:j + 1] for w in line])
                for name, template in L._templates().items():
                    value = L.dice(block, template)
                    if value >= L.THRESHOLD:
                        best = min(best or (0,), (-value, j - i, i, name))
        return best[3] if best else None

    assert all(plain(t) == found[i].licence for i, t in enumerate(texts))
    assert L.licences(docs).where("licence is not null").count() == 0


def test_licences_inside_lines(spark):
    from commitloom.llm import licenses as L

    mit = L.TEMPLATES["mit-text"]
    texts = ["Copyright 2020 X. Released under the MIT License. " + "more words " * 300, f"some words before {mit} and {mit.upper()} after; licensed under CC BY 4.0 too", "of the work in the year " * 50]
    found = {r.doc_id: r for r in L.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found[0].licence == "mit" and found[0].dice == 1 and [(m.licence, m.first_word, m.last_word) for m in found[0].matches] == [("mit", 3, 7)]
    assert Counter(m.licence for m in found[1].matches) == {"mit-text": 2, "cc-by-4.0": 1} and found[1].licence is not None
    assert found[2].licence is None and found[2].matches == []
    rng = random.Random(1)
    for _ in range(30):
        flat = [rng.choice(["released", "under", "the", "mit", "license", "licensed", "cc", "by", "4", "0", "x"]) for _ in range(25)]
        best: dict = {}
        for i, j in itertools.combinations(range(25), 2):
            for name, template in L._templates().items():
                value = L.dice(L.bigrams(flat[i:j + 1]), template)
                if value >= L.THRESHOLD:
                    best[name] = max(best.get(name, 0), value)
        told: dict = {}
        for name, value, i, j, _, _ in L.windows(" ".join(flat)):
            assert value == L.dice(L.bigrams(flat[i:j + 1]), L._templates()[name])
            told[name] = max(told.get(name, 0), value)
        assert told == best


def test_mixing(docs, empty, rows):
    from commitloom.llm import mixing as M

    assert M.mixed(empty).count() == 0
    # whole documents are taken, so a document of several times a target's words cannot come near it
    rows = [r for r in rows if len(r[1] or "") < 5000]
    docs = docs.where("text is null or length(text) < 5000")
    first = sorted(M.mixed(docs).collect(), key=lambda r: (r.doc_id, r.size))
    assert first == sorted(M.mixed(docs).collect(), key=lambda r: (r.doc_id, r.size)) and len(first) == len(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in order if s not in capped))
        more = {s for s in order if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * sizes[s] if s in capped else weight[s] * level for s in order}
    source = {r[0]: r[3] for r in rows}
    taken: Counter = Counter()
    for r in first:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(40, 0.05 * target[s]) for s in order)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in first)


def test_personal_data(spark, empty):
    from commitloom.llm import personal as P

    assert P.personal_data(empty).count() == 0
    rng = random.Random(2)
    parts = ["a.b@c.d-e.fr", "x@y", "@z.com", "1.2.3.4.5", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-456.78", "+1", "12 3", "q@w.e@r.t", "1.1.1.1.2.2.2.2"]
    texts = [" ".join(rng.choice([*parts, "word", "né"]) for _ in range(30)) for _ in range(40)] + ["", None, "1" * 50_000]

    def plain(text):
        out = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 13 <= len(d) <= 19 and sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
                out.append(("card", m.span()))
        out += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return ",".join(f"{k}:{a}:{b}" for k, (a, b) in out)

    found = P.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in found.collect():
        if r.doc_id < 42:
            assert r.base == plain(texts[r.doc_id] or "")
        assert r.spans.startswith(r.base)
    told = [f"call secretname at bob@site.org now {_sentences(rng, 1)[0]}" for _ in range(4)] + ["nothing here but words"] * 6
    rows = {r.doc_id: r for r in P.personal_data(spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")).collect()}
    assert all("remove:5:15" in rows[i].spans for i in range(4)) and all(rows[i].spans == "" for i in range(4, 10))
    clean = {r.doc_id: r.text for r in P.sanitised(spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")).collect()}
    assert "secretname" not in clean[0] and "[EMAIL]" in clean[0] and clean[5] == told[5]


def test_terms_are_cut_alike_near_entities_and_in_the_counts(spark):
    from commitloom.llm import personal as P

    told = ["call “secretname” at bob@site.org", "问，秘密项目，或 eve@site.org 的", "问秘密代号ann@site.org转交处。", "dis l’homme joe@site.org"]
    rest = ["la femme et l’homme", "“l’homme”", "rien", "nothing", "，其他，", "else"]
    rows = list(enumerate([t for t in told for _ in range(4)] + rest * 4))
    found = {r.doc_id: r for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def removed(i):
        return {rows[i][1][int(a):int(b)] for kind, a, b in (x.split(":") for x in found[i].spans.split(",")) if kind == "remove"}

    assert "secretname" in removed(0) and "秘密项目" in removed(4) and {"问秘密代号", "转交处"} <= removed(8)
    assert "homme" not in removed(12) and "dis" in removed(12)
    rng = random.Random(9)
    parts = ["l’homme", "“x”", "né", "漢字，仮名", "a1b", "नमस्ते", "²", "Ⅷ", "é@b.co漢", "漢q@w.de", "A_b", "ǅungla", "\u0301"]
    for _ in range(200):
        text = "".join(rng.choice([*parts, " "]) for _ in range(12))
        data = np.frombuffer(text.encode(), np.uint8)
        counted = set(P.term_hashes(data, np.array([0, len(data)]))[0].tolist())
        spans = P.entities(text)
        assert {term for _, term, _, _ in P.nearby(text, spans)} <= counted
        if not spans:
            assert {P._term_hash(m) for m in re.findall(r"[^\W\d_]+", text)} == counted


def test_phrases(docs, empty, rows):
    from commitloom.llm.phrases import passages_removed

    assert passages_removed(empty).count() == 0
    found = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages_removed(docs).collect()}
    seen, expected = set(), set()
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}):
        words = WORD.findall(text)
        gone = set()
        for i in range(len(words) - 19):
            key = tuple(words[i:i + 20])
            if key in seen:
                gone |= set(range(i, i + 20))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        expected.add((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert found == expected


def test_suffixes(docs, empty, rows):
    from commitloom.llm.suffixes import repeats_removed

    assert repeats_removed(empty).count() == 0
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats_removed(docs).collect())
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(t[i:i + 200] for _, t in texts for i in range(len(t) - 199))
    expected: Counter = Counter()
    for doc_id, text in texts:
        gone = np.zeros(len(text) + 2, bool)
        for i in range(len(text) - 199):
            if count[text[i:i + 200]] > 1:
                gone[i + 1:i + 201] = True
        kept = bytes(b for b, g in zip(text, gone[1:]) if not g)
        expected[(doc_id, len(text), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert found == expected


@pytest.mark.parametrize("most_bytes", ["20000", "64MB"])
def test_suffixes_where_scans_cut_batches_by_bytes(spark, most_bytes):
    """Rows whose Arrow batches are cut by bytes: a small cut, and over 64 MB of text under the default one."""
    from commitloom.llm.suffixes import repeats_removed
    from commitloom.llm.tables import stored

    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(300))
    sizes = [rng.randint(50, 700) for _ in range(1600)] if most_bytes == "20000" else [((64 << 20) - 40_000) // 60] * 60 + [100] * 1600
    rows, gone = [], {}
    for n, size in enumerate(sizes):
        edge = chr(33 + n // 20) if n % 20 == 1 else ""  # no two of the copies have a neighbour letter in common
        rows.append((n, rng.randbytes((size + 1) // 2).hex()[:size] + (edge + shared + edge if edge else "")))
        gone[n] = 300 if edge else 0
    kept = {i: hashlib.sha256(t.replace(shared, "").encode()).hexdigest() for i, t in rows}
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, most_bytes)
        table = stored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id"))
        found = {r.doc_id: (r.n_removed, r.kept_sha256) for r in repeats_removed(table).collect()}
    finally:
        spark.conf.set(name, before)
    assert found == {i: (gone[i], kept[i]) for i, _ in rows}


def test_deep_shallow_order():
    from commitloom.llm.suffixes import common, deep_shallow

    rng = random.Random(3)
    strings = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(200)})
    order = deep_shallow(strings)
    assert [strings[i] for i, _ in order] == sorted(strings)
    assert all(shared == common(strings[a], strings[b]) for (a, _), (b, shared) in zip(order, order[1:]))


def test_toxicity(spark, empty):
    from commitloom.llm import toxicity as T

    rng = random.Random(6)
    texts, marks = [], []
    for i in range(400):
        words = _sentences(rng, 40)
        marks.append(int(i % 3 == 0))
        if marks[-1]:
            words[rng.randrange(40)] = rng.choice(["vile", "Awful!"])
        texts.append(" ".join(words))
    table = spark.createDataFrame([(i, t, "en", 7.0) for i, t in enumerate([*texts, "", None])], "doc_id long, text string, lang string, score double")
    marked = spark.createDataFrame([*[(i, m) for i, m in enumerate(marks)], (3, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in T.toxicity(table, marked).collect()}
    assert len(found) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out == (i in held) for i in range(400))
    assert np.mean([found[i].predicted == marks[i] for i in held]) > 0.9
    assert T.toxicity(empty, marked).count() == 0
    assert T.without_toxic(table, marked).columns == table.columns
    assert all(r.score == 0 for r in T.toxicity(table, marked.limit(0)).collect())


def test_exact_copies(docs, empty, rows):
    from commitloom.llm import exact as E

    assert E.exact_groups(empty).count() == 0
    lower = [(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in rows]
    last, size = {}, Counter(t for _, t in lower)
    for doc_id, text in lower:
        last[text] = max(last.get(text, -1), doc_id)
    expected = Counter((d, last[t], size[t], d == last[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in lower)
    assert Counter(tuple(r) for r in E.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == expected
    assert E.without_copies(docs).columns == docs.columns


@pytest.mark.parametrize("kind", ["exact", "near"])
def test_copies_go_alone_where_doc_ids_are_null_or_repeat(spark, kind):
    from commitloom.llm import exact, minhash

    rng = random.Random(12)
    copy, a, b, c, d, lone = (_sentences(rng, 80) for _ in range(6))

    def text(words, at):  # near copies have one word changed
        return " ".join([*words[:at], "other", *words[at + 1:]] if kind == "near" else words)

    rows = [(5, text(copy, 1)), (None, text(copy, 30)), (7, text(copy, 50)), (9, text(copy, 70)), (None, text(a, 3)), (None, text(b, 3)), (7, text(c, 3)), (9, text(d, 3)),
            (5, text(a[:40] + b[:40], 3)), (None, text(lone, 1)), (None, text(lone, 60)), (None, None), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = exact.without_copies(docs) if kind == "exact" else minhash.without_near_copies(docs)
    gone = Counter([(i, t) for i, t in rows[:4] if i != (9 if kind == "exact" else 5)] + [(None, None)])
    assert kept.columns == docs.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter(rows) - gone


def test_cuckoo_filter_grows_and_forgets():
    from commitloom.llm.exact import LiveIndex

    index, keys = LiveIndex(), [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, key in enumerate(keys):
        index.put(key, i, 1)
    index.put(keys[7], 9000, 2)
    assert all(k in index.filter for k in keys) and index.content[keys[7]] == (9000, 3)
    assert all(index.remove(k) for k in keys[:2500]) and not index.remove(keys[0])
    assert all(k in index.filter for k in keys[2500:]) and len(index.content) == 2500


def test_bpe(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from commitloom.llm import bpe as B

    path = public_tokenizers.path("word_bpe_49k.json")
    assert B.encoded_digests(empty, path).count() == 0
    peer, own = Tokenizer.from_file(path), B.coder(path)
    peer.no_padding()
    peer.no_truncation()
    texts = [r.text or "" for r in docs.collect()] + ["don't WE'LL <|endoftext|>x", "ΑΣ ẞ İ\x1cb\x85c", "ｶﾞ नमस्ते 😀 \x00", "K Å é"]
    for text in texts:
        ids = peer.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == (" ".join(map(str, ids)), peer.decode(ids, skip_special_tokens=False), len(ids))
        assert own.decode(ids) == peer.decode(ids, skip_special_tokens=False)


def test_near_duplicates(docs, empty, rows):
    from commitloom.llm.minhash import near_duplicates, without_near_copies

    assert near_duplicates(empty).count() == 0
    sets: dict = {}
    for r in rows:
        words = WORD.findall((r[1] or "").lower())
        sets[r[0]] = Counter(tuple(words[i:i + 5]) for i in range(max(min(1, len(words)), len(words) - 4)))
    top = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        low = sum(min(1 + np.log(x[k]), 1 + np.log(y[k])) for k in x.keys() & y.keys())
        all_ = sum(1 + np.log(n) for n in [*x.values(), *y.values()]) - low
        if (not x and not y) or (x and y and low / all_ >= 0.8):
            old, new = max(top[a], top[b]), min(top[a], top[b])
            top = {k: new if v == old else v for k, v in top.items()}
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows) and all(r.class_id == top[r.doc_id] and r.kept == (r.doc_id == r.class_id) for r in found)
    assert without_near_copies(docs).columns == docs.columns


@pytest.mark.parametrize("members_of_a_block", [512, 40, 7])
def test_near_duplicates_of_one_hub_lose_no_link(spark, monkeypatch, members_of_a_block):
    """One group of three families of edited texts: classes equal those of all pairs, from few links."""
    import commitloom.llm.minhash as M

    rng = np.random.default_rng(3)
    texts = []
    for family, (n, most) in enumerate([(90, 14), (40, 10), (25, 30)]):
        base = [f"w{family}x{i}" if i > 30 else f"common{i}" for i in range(150)]
        for _ in range(n):
            words = list(base)
            for at in rng.integers(0, 150, rng.integers(0, most)):
                words[at] = f"e{rng.integers(0, 60)}"
            texts.append(" ".join(words[: 150 - int(rng.integers(0, 25))]))
    texts += [" ".join(["same"] * 40), " ".join(f"only{i}" for i in range(30))]
    texts = sorted(set(texts))
    idf = np.ones(M.COUNTERS, np.float32)
    ids = [bytes([i]) for i in range(len(texts))]
    found = spark.createDataFrame(list(zip(ids, texts)), "node binary, text string")
    members = found.selectExpr("node", "1L AS group", f"{len(ids)}L AS n")
    stars = M.stored(M.similarities(M._stars(members), found, idf, outside=True))
    edges = M.shortened(stars.where("similarity >= 0.8").selectExpr("hub AS a", "node AS b"))
    monkeypatch.setattr(M, "MEMBERS", members_of_a_block)
    joining = M.stored(M._links(M._apart(stars, edges), found, idf))
    links = edges.unionByName(joining.selectExpr("hub AS a", "node AS b"))
    classes = {bytes(r.node): bytes(r.component) for r in M.components(links).collect()}
    sets = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        h, w, _, _ = M.weighted(data, np.array([0, len(data)]), idf)
        sets.append(dict(zip(h.tolist(), w.tolist())))
    top = dict(zip(ids, ids))
    for (a, x), (b, y) in itertools.combinations(zip(ids, sets), 2):
        low = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
        if low / (sum(x.values()) + sum(y.values()) - low) >= 0.8:
            old, new = max(top[a], top[b]), min(top[a], top[b])
            top = {k: new if v == old else v for k, v in top.items()}
    assert {i: classes.get(i, i) for i in ids} == top
    assert 5 < len(set(top.values())) < len(ids) - 5
    blocks = -(-len(ids) // members_of_a_block)
    assert joining.count() < len(ids) * (blocks + 1)


def test_components(spark):
    from commitloom.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_edit_fingerprints(docs, empty, rows):
    from commitloom.llm import editprint as X

    assert X.neighbour_prints(empty).count() == 0
    found = X.neighbour_prints(docs).collect()
    assert len(found) == len(rows)
    ordered = sorted({(r[0], r[1] or "") for r in rows})
    once = {r.doc_id: r for r in found if r.doc_id != 2}
    for (doc_id, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]]):
        if doc_id == 2:
            continue
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        r = once[doc_id]
        prints = X.fingerprints([text, changed, after])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[0].tobytes().hex(), prints[1].tobytes().hex())
        assert (r.near_edited, r.near_next) == (X.likeness(prints[0], prints[1]), X.likeness(prints[0], prints[2]))
    long = [r for r in found if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.6


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline as C

    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(C.STAGES) <= 5
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        docs = C.stored(kept)
    found = C.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in docs.collect())


def test_toxicity_learns_every_labelled_row(spark, monkeypatch):
    """Parts of 40 rows: each text's only word is learned, wherever its row was dealt, and thresholds count all parts."""
    from commitloom.llm import toxicity as T

    texts = [f"vile{i}" if i % 3 == 0 else f"kind{i}" for i in range(600)]
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    marked = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    net, fresh = T.trained(table, marked, 40), T.Network.fresh(T.SEED)
    moved = (net.halves != fresh.halves).any(axis=2)
    used = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 != 2]
    learned = 0
    for i in used:
        data = np.frombuffer(texts[i].encode(), np.uint8)
        learned += moved[0][T.word_ids(data, np.array([0, len(data)]))[0][0][0]]
    assert learned > 0.7 * len(used)  # about a fifth is kept for thresholds
    assert set(net.thresholds) == {"en"}  # no part has enough toxic rows of its own
    monkeypatch.setattr(T, "BROADCAST_LABELS", 0)
    again = T.trained(table, marked, 40)
    assert (again.halves == net.halves).all() and again.thresholds == net.thresholds


def test_bpe_makes_a_piece_once():
    """As many pieces as a worker meets in some thousand texts are encoded once, and pieces without tokens leave no blank."""
    import public_tokenizers

    from commitloom.llm import bpe as B

    coder, made = B.ForcedBoundaryBpe(public_tokenizers.path("word_bpe_49k.json")), Counter()
    coder.pieces.make = lambda piece: made.update([piece]) or (piece, piece, 1 if piece != "none" else 0)
    text = " ".join(f"{i:x}" for i in range(250_000))
    assert coder.encode(text) == coder.encode(text) == (text, text, 250_000)
    assert max(made.values()) == 1
    assert coder.encode("a none b") == ("a b", "a b", 2) and coder.encode("none") == coder.encode("") == ("", "", 0)
