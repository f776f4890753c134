"""Each operator against brute force, on awkward rows and on a small table."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
PROSE = "the quick brown fox jumps over the lazy dog while seven bright stars look down " * 6
ROWS = [
    (1, None), (2, ""), (3, "   \n "), (4, "a"), (5, PROSE), (6, PROSE), (6, PROSE), (7, PROSE + "and then some"),
    (8, "ça va où 日本語 😀 <|endoftext|>  two  spaces"), (9, "x" * 5000), (10, "one two three"), (11, "One TWO three"),
    (12, "mail bob@example.com or 10.0.0.1, 4111 1111 1111 1111 and +1 (555) 555-0100"), (None, "no id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t, "n", 1, 2) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, score int, block int").repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def words(text):
    return text.encode().lower().split()


def test_bpe_matches_the_library(docs, small):
    from tokenizers import Tokenizer

    from tidelog.llm.bpe import bpe_decode, bpe_digests, bpe_encode
    from tidelog.llm.queries import BYTE_BPE, tokenizer_path

    path = tokenizer_path(BYTE_BPE)
    tokenizer = Tokenizer.from_file(path)
    for df in (docs, small.select("doc_id", "text")):
        want = Counter()
        for i, text in texts(df):
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            back = tokenizer.decode(ids, skip_special_tokens=False)
            digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            want[(i, len(ids), digest, hashlib.sha256(back.encode()).hexdigest())] += 1
        assert Counter(map(tuple, bpe_digests(df, path).collect())) == want
    assert Counter(texts(bpe_decode(bpe_encode(docs, path), path))) == Counter(texts(docs))
    assert bpe_digests(docs.limit(0), path).count() == 0


def test_packing_is_gapless_and_matches_the_library(docs, small):
    from tokenizers import Tokenizer

    from tidelog.llm.packing import best_fit_packing, pack, token_pieces
    from tidelog.llm.queries import WORD_BPE, tokenizer_path

    path = tokenizer_path(WORD_BPE)
    tokenizer = Tokenizer.from_file(path)
    for df in (docs, small.select("doc_id", "text")):
        rows = best_fit_packing(token_pieces(df, path)).collect()
        want = Counter()
        for i, text in texts(df):
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
            for p in range(0, len(ids), 2048):
                own = np.array(ids[p : p + 2048], "<u4")
                want[(i, p // 2048, p, len(own), zlib.crc32(own.tobytes()))] += 1
        assert Counter((r[0], r[1], r[2], r[3], r[4]) for r in rows) == want
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
    assert sorted(len(b) for b in pack([700, 700, 700, 600, 600], 2048)) == [1, 2, 2] or len(pack([700, 700, 700, 600, 600], 2048)) == 2
    assert best_fit_packing(token_pieces(docs.limit(0), path)).count() == 0


def test_context_tree_base_and_normalisation(docs, small):
    import math

    from pyspark.sql import functions as F

    from tidelog.llm.context_tree import score_texts

    rule = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    own = small.select("doc_id", "text")
    counts, total = Counter(), 0
    for i, text in texts(own):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(text), None])
            total += len(words(text)) + 1
    by_id = dict(texts(own))
    rows = score_texts(own, rule).collect()
    for r in rows:
        tokens = [*words(by_id[r["doc_id"]]), None]
        want = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in tokens)
        assert r["base_score"] == pytest.approx(want)
        assert (r["n_tokens"], r["train_tokens"]) == (len(tokens), total)
        assert r["n_known"] == sum(t in counts for t in tokens)
    assert sum(r["score"] for r in rows) > 1.1 * sum(r["n_bytes"] for r in rows) * -math.log10(256)
    assert score_texts(docs, rule).count() == len(ROWS)
    assert score_texts(docs.limit(0), rule).count() == 0


def test_toxicity(docs, small, spark):
    from tidelog.llm.toxicity import fit_toxicity, toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_toxicity(small, labels)
    rows = {r["doc_id"]: r for r in toxicity(small, model).collect()}
    known = [(rows[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in rows]
    assert sum(r["predicted"] == y for r, y in known) >= 0.9 * len(known)
    odd = toxicity(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity(docs.limit(0), fit_toxicity(docs.limit(0), labels.limit(0))).count() == 0


def test_disguised_words_are_restored():
    from tidelog.llm.toxicity import CODES, SIZE, Restorer, disguised

    counts = np.zeros(SIZE**3, np.int64)
    for word in ["idiot", "stupid", "scum", "the", "and", "other"] * 50:
        code = [0, 0, *(CODES[c] for c in word), 0, 0]
        for a, b, c in zip(code, code[1:], code[2:], strict=False):
            counts[(a * SIZE + b) * SIZE + c] += 1
    restorer = Restorer(counts)
    for disguise, word in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("stuuuupid", "stupid"), ("s.c.u.m", "scum")):
        assert restorer.restore(disguise) == word
    assert not disguised("plain") and not disguised("plain,")


def test_spaced_words_reach_the_decoder_whole():
    from tidelog.llm.toxicity import CODES, SIZE, Scorer, ToxicityModel

    counts = np.zeros(SIZE**3, np.int64)
    prose = np.random.default_rng(1).permutation(["idiot", "stupid", "scum", "the", "and", "other", "a", "as"] * 50)
    code = [0, 0, *(CODES.get(c, 0) for c in " ".join(prose)), 0, 0]
    for a, b, c in zip(code, code[1:], code[2:], strict=False):
        counts[(a * SIZE + b) * SIZE + c] += 1
    scorer = Scorer(ToxicityModel(counts, {"scum": 5.0, "idiot": 5.0, "stupid": 5.0}, 1.0, 0.0))
    for text in (
        "s c u m", "what s c u m.", "s c u m, go", "(s c u m)", "( s c u m )", '"s.c.u.m"', "S C U M !", "i d ! 0 t",
        "$ c u m", "you $ c u m!", "a s t u p i d man", "such a s c u m", "s_c_u_m?", "s c * m", "i a s t u p i d",
    ):
        assert scorer.evidence(text) == 5.0, text
    assert scorer.evidence("s t u p i d  i d i o t") == 10.0
    for text in ("the other and 1 2 3 4", "* * *", "| | | |", "a b c", "- - -", "other " * 9):
        assert scorer.evidence(text) == 0.0, text


def brute_kept(rows, length):
    data = [t.encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        cover = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((i, len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("most", [1500, 2])
def test_suffix_dedup(docs, small, most):
    from tidelog.llm.suffix_dedup import kept_bytes, repeated_spans

    for df in (docs, small.select("doc_id", "text")):
        spans = repeated_spans(df, most_segments=most)
        got = kept_bytes(df, spans).drop("kept")
        assert Counter(map(tuple, got.collect())) == brute_kept(texts(df), 200)
    assert kept_bytes(docs.limit(0), repeated_spans(docs.limit(0))).count() == 0


def test_ngram_components(docs, small):
    from tidelog.llm.ngram_join import ngram_components

    for df in (docs.where("doc_id is not null"), small):
        sets = {}
        for i, text in texts(df):
            w = words(text)
            sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        root = {i: i for i in sets}
        changed = True
        pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) > 0]
        while changed:
            changed = False
            for a, b in pairs:
                low = min(root[a], root[b])
                changed |= root[a] != low or root[b] != low
                root[a] = root[b] = low
        want = Counter((i, len(sets[i]), root[i]) for i, _ in texts(df))
        assert Counter(map(tuple, ngram_components(df).collect())) == want
    assert ngram_components(docs.limit(0)).count() == 0


def test_nearest(spark):
    from tidelog.llm.nn_descent import nearest

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(400 + i, [1.0] * 8) for i in range(9)]
    odd = [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] * 8), (504, [1.0] * 3), (50, None)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    ids = np.array([i for i, _ in rows])
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert got[400] == [401, 402, 403, 404, 405]
    hit = 0
    for q, found in got.items():
        cosine = np.round(unit @ unit[ids == q][0], 12)
        cosine[ids == q] = -9
        hit += len(set(ids[np.lexsort((ids, -cosine))[:5]]) & set(found))
    assert set(got) == {i for i, _ in rows if i % 50 == 0}
    assert hit >= 0.9 * 5 * len(got)
    assert nearest(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_ngram_join_by_rows(spark):
    """Repeated ids with other texts and rows without an id are sets of their own; the stage
    keeps the first row of each group, whatever the partitions."""
    from tidelog.llm.ngram_join import ngram_components
    from tidelog.llm.stages import ngram_jaccard_stage

    def prose(start):
        return " ".join(f"w{start + i}" for i in range(40))

    rows = [
        (1, prose(0), "b"), (1, prose(100), "b"), (2, prose(0), "b"), (3, prose(100) + " more", "b"), (4, prose(200), "b"),
        (4, prose(200), "a"), (None, prose(200), "a"), (None, prose(300), "a"), (None, prose(300) + " more", "a"),
        (None, prose(400), "a"), (5, prose(0) + " " + prose(100), "b"), (6, "", "b"), (7, None, "b"), (None, "", "b"),
    ]
    sets = []
    for _, text, _ in rows:
        w = words(text or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                near = 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0
                if near or rows[a][:2] == rows[b][:2]:
                    root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(rows[i])
    least = {r: min((i for i, _, _ in own if i is not None), default=None) for r, own in groups.items()}
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        want = Counter((row[0], len(s), least[r]) for row, s, r in zip(rows, sets, root, strict=True))
        assert Counter(map(tuple, ngram_components(df, words=5, percent=80).collect())) == want
        got = [tuple(r) for r in ngram_jaccard_stage(spark, df, "").collect()]
        assert len(got) == len(groups)
        for own in groups.values():
            ids = [i for i, _, _ in own if i is not None]
            kept = [r for r in got if any(r[:2] == x[:2] for x in own)]
            assert len(kept) == 1 and kept[0][0] == min(ids, default=None)
        assert (4, prose(200), "a") in got


@pytest.mark.parametrize("distinct", [1, 2, 6, 17, 24, 60])
def test_nearest_of_few_vectors(spark, distinct):
    """Every query gets all candidates if there are fewer than it wants, and the right ones."""
    from tidelog.llm.nn_descent import nearest

    rng = np.random.default_rng(distinct)
    vectors = rng.normal(size=(distinct, 8))
    # One vector alone stands for a table whose rows are all equal.
    rows = [(i, vectors[i % distinct].tolist()) for i in range(9 if distinct == 1 else distinct)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, "vec_id % 3 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in range(0, len(rows), 3):
        cosine = np.round(unit @ unit[q], 12)
        cosine[q] = -9
        want = np.lexsort((np.arange(len(rows)), -cosine))[: min(5, len(rows) - 1)].tolist()
        assert got.get(q, []) == want


def test_pii(docs, small):
    from tidelog.llm.pii import fit_pii, pii_spans

    model = fit_pii(small)
    rows = {r["doc_id"]: r for r in pii_spans(docs, model).collect()}
    own = rows[12]
    assert (own["n_email"], own["n_ip"], own["n_card"], own["n_phone"]) == (1, 1, 1, 1)
    assert own["spans"].startswith("email:5:20,ip:24:32,card:34:53,phone:58:")
    assert rows[1]["spans"] == "" and rows[5]["spans"] == ""
    assert pii_spans(docs.limit(0), fit_pii(docs.limit(0))).count() == 0


def test_descent_ends_by_its_own_rule(spark, monkeypatch):
    from tidelog.llm import nn_descent

    turns = []

    def found(graph, vectors, degree, sample, turn):
        turns.append(turn)
        rows = [(a, (a + turn + 1) % 40, 2.0 + turn, 1) for a in range(40)] if turn < 9 else []
        return spark.createDataFrame(rows, nn_descent.LINKS)

    monkeypatch.setattr(nn_descent, "local_joins", found)
    rng = np.random.default_rng(1)
    nodes = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "node long, vector array<double>")
    nn_descent.neighbour_graph(nn_descent.packed(nodes, 4), degree=2)
    assert turns == list(range(10))


def test_disguised_addresses_are_candidates():
    from tidelog.llm.pii import candidates

    for own in ("jane{at}mail{dot}org", "jane at mail.org", "jane ( at ) mail.org", "jane@mail.org", "Jane [AT] mail [DOT] org"):
        assert ("email", 0, len(own)) in candidates(own)
        assert ("email", 4, 4 + len(own)) in candidates(f"so: {own}, then")
    assert not candidates("that is flat data")


def test_pii_finds_unseen_ways_of_writing(spark, small):
    """Values in ways of writing that no fitted tree saw are found where they stand, and texts
    without personal data stay as they are."""
    import random

    from tidelog.llm import pii

    model = pii.fit_pii(small)
    rows = [t for _, t in texts(small)]
    rng = random.Random(99)
    found, total = Counter(), Counter()
    for i in range(600):
        kind = pii.KINDS[i % len(pii.KINDS)]
        text, (_, start, end) = pii.planted(rng, rng.choice(rows), kind, True)
        base, every = model.spans(text)
        total[kind] += 1
        found[kind] += any(
            k == kind and abs(e - end) <= 1 and (abs(s - start) <= 1 or (kind == "secret" and s >= start)) for k, s, e in every
        )
        assert set(base) <= set(every)
    assert all(found[kind] >= 0.9 * total[kind] for kind in pii.KINDS), (found, total)
    clean = [t for t in rows if not pii.base_spans(t) and not pii.NAMED.search(t) and not pii.KEY.search(t)]
    assert len(clean) > 50
    assert all(model.spans(t)[1] == [] for t in clean)
    numbers = ["1. one 2. two 3. three", "see 2024-10-11 12:30:05", "version 10.2.1", "pages 100-200, 300-400", "3,141,592 of 10,000,000"]
    assert all(model.spans(t)[1] == [] for t in numbers)


def test_pii_counts_all_spans(spark, small):
    from tidelog.llm.pii import fit_pii, pii_spans

    df = spark.createDataFrame([(1, "a@b.org and 10.0.0.1"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_spans"], r["spans"]) for r in pii_spans(df, fit_pii(small)).collect())
    assert got == [(1, 2, "email:0:7,ip:12:20"), (2, 0, ""), (3, 0, ""), (3, 0, "")]


def test_pii_sample_is_not_filled_by_copies(spark):
    from tidelog.llm.pii import fit_pii

    texts = [f"write to user{i}@host{i % 7}.example.org or call +1 555 {i:03d} {1000 + i}, not {i}.{i}.{i}" for i in range(300)]
    hot = "numbers " + " ".join(f"+49 30 {i:03d} {2000 + i}" for i in range(60))
    plain = fit_pii(spark.createDataFrame([(t,) for t in [*texts, hot]], "text string"), sample_docs=200, sample_rows=600)
    copies = spark.createDataFrame([(t,) for t in texts + [hot] * 300], "text string").repartition(5)
    other = fit_pii(copies, sample_docs=200, sample_rows=600)
    assert other.thresholds == plain.thresholds
    assert plain.thresholds["email"] <= 1


def test_imatch(docs, small):
    from tidelog.llm.imatch import imatch_fingerprints, likeness_of_texts

    for df in (docs.where("doc_id is not null"), small):
        rows = sorted(texts(df))
        want = Counter()
        for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            want[(i, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
        got = imatch_fingerprints(df, part_bytes=4000).collect()
        assert Counter((r[0], r[1], r[2]) for r in got) == want
        for r in got:
            assert r["near_edited"] == pytest.approx(likeness_of_texts(r["fingerprint"], r["edited_fingerprint"]))
    assert imatch_fingerprints(docs.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in rows}
    assert 0 < len(ids) < 200


def test_token_counts(docs, small):
    from tidelog.llm.queries import tokenizer_path
    from tidelog.llm.token_counts import MARK, UNKNOWN, pieces, token_counts

    path = tokenizer_path("piece_bpe_32k.model")
    scores, longest = pieces(path)
    known = {}

    def count(word):
        if word not in known:
            best = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                ways = [(best[-1][0] + UNKNOWN, best[-1][1] - len(word[end - 1].encode()))]
                ways += [
                    (best[s][0] + scores[word[s:end]], best[s][1] - 1)
                    for s in range(max(0, end - longest), end)
                    if word[s:end] in scores
                ]
                best.append(max(ways))
            known[word] = -best[-1][1]
        return known[word]

    for df in (docs, small.limit(40)):
        df = df.select("doc_id", "text").cache()
        want = Counter()
        for i, text in texts(df):
            own = [MARK + w.decode() for w in text.encode().split()]
            want[(i, len(own), sum(map(count, own)))] += 1
        assert Counter(map(tuple, token_counts(df, path).collect())) == want
    assert token_counts(docs.limit(0), path).count() == 0


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"


def test_base_rules_are_the_leftmost_matches():
    import random
    import re

    from tidelog.llm.pii import base_spans

    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choices("a1.@-+ 2", weights=(3, 4, 5, 3, 1, 1, 1, 2), k=rng.randrange(40)))
        want = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, text)]
        want += [("ip", m.start(), m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in base_spans(text) if s[0] in ("email", "ip")] == sorted(want, key=lambda s: (s[1], s[0] != "email"))


def test_long_runs_are_read_once():
    import time

    from tidelog.llm.boosting import fit_trees
    from tidelog.llm.pii import N_FEATURES, PiiModel, base_spans

    million = 200_000
    model = PiiModel(fit_trees(np.zeros((0, N_FEATURES)), np.zeros(0)), {})
    for text in ("a" * million + " x@y.z", "1" * million, "." * million, "+" * million, "1." * million, "@" * million, "+1" + " " * million):
        begin = time.perf_counter()
        model.spans(text)
        assert time.perf_counter() - begin < 20
    assert base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]


def test_stages_keep_columns_of_any_name(spark):
    from tidelog.llm.stages import ngram_jaccard_stage, suffix_array_stage

    long = PROSE * 3
    rows = [(1, long, "de"), (2, "another text of some few words", None), (3, "x" * 10, "fr"), (4, long + "end", "de"), (None, None, None)]
    names = ["_key", "_uid", "_spans", "_text", "id", "component", "row", "a.b", "doc", "uid"]
    docs = spark.createDataFrame(
        [(*r, {"k": "v"}, *(f"{n}-{r[0]}" for n in names)) for r in rows],
        "doc_id long, text string, lang string, tags map<string,string>, " + ", ".join(f"`{n}` string" for n in names),
    )
    for stage, ids in ((ngram_jaccard_stage, {1, 2, 3, None}), (suffix_array_stage, {1, 2, 3, 4, None})):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = out.collect()
        assert {r["doc_id"] for r in kept} == ids and len(kept) == len(ids)
        for r in kept:
            assert [r[n] for n in names] == [f"{n}-{r['doc_id']}" for n in names] and r["tags"] == {"k": "v"}


def test_pii_learns_from_every_distinct_text(spark, small):
    """What the trees are fitted on is counted over all texts, copies once."""
    import inspect

    from tidelog.llm import pii

    assert inspect.signature(pii.fit_pii).parameters["sample_docs"].default is None
    assert inspect.signature(pii.fit_pii).parameters["sample_rows"].default is None
    rows = small.select("text").limit(40)
    every = rows.union(rows).repartition(3)
    want = Counter()
    for text in {r["text"] or "" for r in rows.collect()}:
        want[text] = {side: len(pii.labelled(text, bool(side))) for side in (0, 1)}
    got = pii.counted(pii.coded(every, "text")).collect()
    total = sum(r["n"] for r in got)
    assert sum(min(w.values()) for w in want.values()) <= total <= sum(max(w.values()) for w in want.values())
    assert {len(r["code"]) for r in got} == {pii.N_FEATURES + 2} and len(pii.EDGES) == pii.N_FEATURES


def test_addresses_are_what_the_rules_match():
    import random

    from tidelog.llm import pii

    rng = random.Random(5)
    parts = ["a", "bob", "x.y", "@", " at ", "(at)", "[ at ]", "{at}", " ", ".", " dot ", "(dot)", "-", "\n", "at", " AT ", "com", "a" * 70]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        want = {("email", m.start(), m.end()) for rule in (pii.MORE["email"], pii.STRICT) for m in rule.finditer(text)}
        assert {s for s in pii.candidates(text) if s[0] == "email"} == want


def test_packs_name_a_row_once(spark, small):
    """The key of a row travels once, not with every range of hashes."""
    from tidelog.llm.ngram_join import text_incidence

    docs = small.limit(200)
    rows = text_incidence(docs, 4, 7, "doc_id", "text").collect()
    assert sum(len(r["docs"] or b"") for r in rows) == 8 * docs.count()
    assert len({r["range"] for r in rows if r["rows"]}) == 128


def test_stages_bound_their_batches(spark):
    from tidelog.llm.stages import suffix_array_stage

    docs = spark.range(400).selectExpr("id as doc_id", "repeat(cast(id as string), 20000) as text").coalesce(1)
    suffix_array_stage(spark, docs.limit(1), SF)

    def sizes(batches):
        for batch in batches:
            yield batch.select([]).from_pydict({"n": [batch.nbytes]})

    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 8 << 20
