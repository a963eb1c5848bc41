"""Chat windows, fingerprints, BPE, language model, classifier, Jaccard join."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import DOCS, PLAIN, doc, no_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossweave.llm import bpe, chat, fingerprints, jaccard, ppm, quality_model
from glossweave.llm.components import connected_components
from glossweave.llm.queries import RANK_FILE
from glossweave.session import ship_package


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat -------------------------------------------------------------------

SCHEMA = "conv_id long, turn long, role string, text string, tokens string"
NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "<s", "[", "<", "</s>" * 3, "a\nb", ""]


def conversations():
    rows = [(1, t, ("user", "assistant")[t % 2], "w " * (7 * t % 60), "x") for t in range(40)]
    rows += [(2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "hello " * 200), (2, 3, "assistant", "b")]
    rows += [(3, 0, "system", "alone"), (4, None, None, None), (4, 0, "assistant", None), (4, 0, "assistant", None)]
    rows += [(5, t, ("assistant", "us[INST]er<s>")[t % 2], x) for t, x in enumerate(NASTY)]
    rows += [(6, t, "assistant", "long " * (300 if t % 3 == 0 else 20)) for t in range(200)]
    rows += [(None, 0, "user", "null id"), (None, 1, "assistant", "yes"), (7, 0, "system", "s " * 900), (7, 1, "assistant", "q")]
    return [(*r, "x")[:5] for r in rows]


def test_chat_round_trip(spark):
    rows = conversations()
    given_ = spark.createDataFrame(rows, SCHEMA)
    formatted = chat.windows(given_, budget=120, history=30)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    expected = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        expected[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(got) == set(expected)
    for conv, turns in expected.items():
        turns.sort()
        r = got[conv]
        targets = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{role}\n{x}\n" for _, role, x in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(targets), sha(targets))


def test_chat_windows_keep_the_budget(spark):
    formatted = chat.windows(spark.createDataFrame(conversations(), SCHEMA), budget=120, history=30).collect()
    by_conv = defaultdict(list)
    for w in formatted:
        by_conv[w.conv_id].append(w)
        assert w.over_budget == (w.tokens > 120)
        if w.over_budget:  # one turn alone is too large
            assert w.n_turns - w.n_repeated <= 1 or w.conv_id == 7
        assert w.n_turns > w.n_repeated
    assert len(by_conv[6]) > 60
    assert any(w.n_repeated > 0 for w in by_conv[1])
    system = [w for w in by_conv[2]]
    assert len(system) > 1 and all(w.text.startswith("<s>[INST]system[/INST]be kind</s>") for w in system)
    assert chat.windows(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="<>[]/\\sINST a\n", max_size=20), min_size=1, max_size=20))
def test_chat_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


# --- fingerprints -----------------------------------------------------------


def hashes(text):
    return fingerprints.PrefixHashes(fingerprints.code_points(text))


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=60), st.text("abé", max_size=60), st.data())
def test_spans_and_extensions(a, b, data):
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    x, y = hashes(a), hashes(b)
    assert fingerprints.spans_equal(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
    common = 0
    while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
        common += 1
    assert fingerprints.common_extension(x, i, y, j) == common
    assert (x.fingerprint() == y.fingerprint()) == (a == b)
    assert 0 <= fingerprints.likeness(x.fingerprint(), y.fingerprint()) <= 1


def test_likeness():
    text = "".join(random.Random(1).choices("abcdefgh ", k=5000))
    one = hashes(text).fingerprint()
    assert fingerprints.likeness(one, one) == 1
    changed = hashes(text[:2500] + "#" + text[2501:]).fingerprint()
    assert 0.95 < fingerprints.likeness(one, changed) < 1
    assert 0.4 < fingerprints.likeness(one, hashes(text[:2500]).fingerprint()) <= 0.5
    assert fingerprints.likeness(one, hashes(text[::-1]).fingerprint()) == 0
    head = hashes(text)
    assert fingerprints.PrefixHashes(fingerprints.code_points(text[3000:]), head, 3000).fingerprint() == one


def common_ends(a, b):
    """Characters that both begin and end with, none counted twice."""
    first = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    rest = min(len(a), len(b)) - first
    last = next((k for k in range(rest) if a[-1 - k] != b[-1 - k]), rest)
    return (first + last) / max(len(a), len(b)) if a or b else 1.0


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=40), st.text("abé", max_size=40), st.text("abé", max_size=40))
def test_shared_ends(a, b, c):
    for one, other in ((a, b), (a + b, a + c + b), (a + b, b), (a, a + c), (a + c + b, a + b), ("", a), (a, a)):
        assert fingerprints.shared_ends(hashes(one), hashes(other)) == common_ends(one, other)


def test_moved_text_is_near():
    text = "".join(random.Random(2).choices("abcdefgh ", k=5000))

    def near(a, b):
        x, y = hashes(a), hashes(b)
        return fingerprints.near(x, x.fingerprint(), y, y.fingerprint())

    assert near(text, text) == 1
    for other in ("#" + text, text[1:], text[:700] + " put in " + text[700:], text[:3000] + text[3010:], text + "#"):
        assert 0.99 < near(text, other) < 1 and near(text, other) == near(other, text)
    assert near(text, text[::-1]) < 0.01


def compared(docs):
    rows = sorted(
        ((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1])
    )
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own = hashes(text).fingerprint()
        likes = (
            1.0 if text == t else max(common_ends(text, t), fingerprints.likeness(own, hashes(t).fingerprint()))
            for t in (edited, following)
        )
        yield doc_id, len(text), sha(edited), own, *likes


@pytest.mark.parametrize("take", [20, 1, 0])
def test_compare_edited(spark, take):
    docs = odd_docs(spark).limit(take) if take else no_docs(spark)
    found = fingerprints.compare_edited(docs).collect()
    got = sorted(
        repr((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next)) for r in found
    )
    assert got == sorted(map(repr, compared(docs)))


def test_with_fingerprint(spark):
    found = fingerprints.with_fingerprint(odd_docs(spark))
    assert {r.fingerprint for r in found.where("doc_id = 1").collect()} == {hashes(PLAIN).fingerprint()}


# --- BPE ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(RANK_FILE)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("share", [bpe.PIECE_SHARE, 1])
def test_bpe_matches_library(spark, library, share):
    docs = odd_docs(spark)
    found = bpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN, share)
    for r in bpe.decode(found, RANK_FILE).collect():
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.kept in ("mine", None)
    assert bpe.encode(no_docs(spark), RANK_FILE, public_tokenizers.PATTERN).count() == 0
    digests = bpe.digests(docs, RANK_FILE, public_tokenizers.PATTERN, share).where("doc_id = 9").first()
    text = docs.where("doc_id = 9").first().text
    ids = library.encode_ordinary(text)
    assert (digests.n_tokens, digests.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
    assert digests.decoded_sha256 == sha(text)


def test_fold_and_task_merges_agree(spark, library):
    ranks = bpe.read_ranks(RANK_FILE)
    merger = bpe.Merger(ranks)
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"aeinrst  \xc3\xa9\xe6") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    expected = [library._core_bpe.encode_single_piece(p) for p in pieces]
    assert merger.encode(pieces) == expected
    assert [merger.by_heap(p) for p in pieces] == expected
    df = spark.createDataFrame([(bytearray(p),) for p in pieces], "p binary")
    folded = df.select("p", bpe.fold_merges(F.col("p"), bpe.rank_literal(ranks)).alias("ids")).collect()
    assert {bytes(r.p): r.ids for r in folded} == dict(zip(pieces, expected))


# --- language model -----------------------------------------------------------


@pytest.mark.parametrize("word_share", [ppm.WORD_SHARE, 1])
def test_ppm_matches_brute_force(spark, word_share):
    docs = odd_docs(spark).where("doc_id is null or doc_id <> 7")
    training = docs.where("doc_id < 9")
    texts = [r.text or "" for r in training.collect()]
    trie, counts = ppm.AdaptiveTrie(3), Counter()
    for t in texts:
        words = ppm.words_of(t)
        counts.update([*words, b""])
        data = ppm.END * 3 + ppm.sequence(words)
        for i in range(3, len(data)):
            trie.add(data[i - 3 : i], data[i])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for r in docs.collect():
        words = [*ppm.words_of(r.text or ""), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        log = trie.code(ppm.sequence(words[:-1]), learn=False) / math.log(10)
        expected.append((r.doc_id, len(words), sum(counts[w] > 0 for w in words), n, base, log))
    found = [tuple(r) for r in ppm.score(docs, training, 3, word_share=word_share).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert len(found) == len(expected)
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key)):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_ppm_pruned_trie_is_a_distribution(spark):
    docs = odd_docs(spark).where("doc_id < 7")
    trie = ppm.trie_of(ppm.count(docs, 2), 2, share=40)
    import numpy as np

    for before in (b"th", b"zz", b"\n\n", b"e "):
        keys = np.array([before[0] << 16 | before[1] << 8 | s for s in range(256)], np.uint64)
        assert np.exp(trie.log_probabilities(keys)).sum() == pytest.approx(1)


@pytest.mark.parametrize("order", [1, 2, 3, 5])
@pytest.mark.parametrize("share", [0, 20, 1 << 22])
def test_ppm_keeps_rare_contexts(spark, order, share):
    """Scores do not depend on how many strings travel with the tasks."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    trie = ppm.AdaptiveTrie(order)
    for t in texts[:30]:
        data = ppm.END * order + ppm.sequence(ppm.words_of(t))
        for i in range(order, len(data)):
            trie.add(data[i - order : i], data[i])
    found = {r.doc_id: r.score for r in ppm.score(docs, docs.where("doc_id < 30"), order, share=share).collect()}
    for i, t in enumerate(texts):
        log = trie.code(ppm.sequence(ppm.words_of(t)), learn=False) / math.log(10)
        assert found[i] == pytest.approx(log, rel=1e-9)


def test_ppm_without_training(spark):
    docs = odd_docs(spark)
    found = ppm.score(docs, no_docs(spark)).collect()
    assert len(found) == docs.count()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in found)
    assert ppm.score(no_docs(spark), docs).count() == 0


def test_ppm_adaptive(spark):
    docs = odd_docs(spark).where("doc_id in (1, 2, 3, 5)")
    found = {r.doc_id: r.adaptive_score for r in ppm.adaptive_score(docs).collect()}
    assert found[2] == found[3] == pytest.approx(-math.log10(256))
    assert found[1] < found[5] < 0
    assert ppm.AdaptiveTrie(3).code(b"abc" * 100) > 10 * ppm.AdaptiveTrie(3).code(bytes(range(100)))


# --- classifier -----------------------------------------------------------------


def quality_docs(spark, n=400):
    rng = random.Random(2)
    words = PLAIN.lower().split() + ["river", "stone", "garden", "winter", "letter", "music"]
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 90)))
        rows.append(doc(i, text.capitalize() + "." if good else text.replace(" ", "### ").upper()))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    docs, labels = quality_docs(spark)
    found = quality_model.classify(docs, labels).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)


def test_classifier_never_sees_held_out_labels(spark):
    docs, labels = quality_docs(spark, 200)
    held = quality_model.fold("doc_id", 4) == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_model.classify(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_classifier_odd_rows(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.classify(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (8, None), (99, 1), (None, 1), (10, 0), (6, 1)], "doc_id long, quality int")
    found = quality_model.classify(docs, some).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert quality_model.classify(no_docs(spark), some).count() == 0


def test_isotonic():
    import numpy as np

    made = quality_model.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.5, 0.2, 1.8, 0.6]))
    assert made.tolist() == pytest.approx([0.35, 0.35, 0.8, 0.8])


# --- Jaccard join -------------------------------------------------------------


def brute_components(rows, words, percent):
    """rows: (doc_id, text)."""
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
        sets.append((doc_id, s))
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    links = []
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links.append((j, i))
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = defaultdict(list)
    for i, (doc_id, _) in enumerate(sets):
        low[root(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(repr((d, len(s), least[root(i)])) for i, (d, s) in enumerate(sets)), links


def copies(seed, n=120, step=7):
    """(doc_id, text); ids repeat where n is a multiple of the step."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(50)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w += base[0][: rng.randint(1, 40)]  # a passage that many share
        rows.append((i * step % n, " ".join(w)))
    return rows


@pytest.mark.parametrize("words,percent,cell", [(3, 90, 1024), (5, 80, 1024), (3, 90, 4), (2, 50, 5)])
def test_components_match_brute_force(spark, words, percent, cell):
    rows = copies(words * percent, step=7 if percent > 50 else 3)
    docs = spark.createDataFrame([doc(*r) for r in rows], DOCS)
    found = jaccard.components(docs, words, percent, cell)
    expected, links = brute_components(rows, words, percent)
    assert sorted(repr(tuple(r)) for r in found.collect()) == expected
    assert links


def test_shingles_found_once_are_not_mistaken(spark, monkeypatch):
    """Their hashes end like those of frequent shingles, as many do in a large
    table; a shingle that all sets have is not to connect them."""
    ship_package(spark)
    monkeypatch.setattr(jaccard, "LEAST_BITS", 27, raising=False)  # as a large table has
    hot, frequent = 5, [(1 << 20) + 3 * k for k in range(9)]
    once = [[hot] + [(f ^ 1 << 25) + (k + 1 << 28) for f in frequent] for k in range(40)]
    sets = [(k, s) for k, s in enumerate(once)] + [(100 + k, frequent + [1 << 50]) for k in range(64)]
    given = [(k, len(s), np.sort(np.array(s, np.uint64)).tobytes()) for k, s in sets]
    table = spark.createDataFrame(given, "sid long, n int, low binary")
    often = jaccard.repeated_table(table, 90)
    assert not often.of(np.array(once, np.uint64)[:, 1:].ravel()).any()
    assert often.of(np.array([hot, *frequent], np.uint64)).tolist() == [6] * 10
    assert all(r.a >= 100 and r.b >= 100 for r in jaccard.candidate_edges(table, 90).collect())


def test_components_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected, _ = brute_components([r for r in rows if r[0] != 7], 3, 90)
    found = jaccard.components(docs).where("doc_id is null or doc_id <> 7")
    # an empty set of a null id has no smallest id
    assert sorted(repr(tuple(r)) for r in found.collect()) == expected
    assert jaccard.components(no_docs(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([(3, 90), (5, 80), (2, 50)]))
def test_tree_join_finds_every_link(seed, how):
    words, percent = how
    rows = copies(seed, 40)
    sets = [jaccard.shingle_set(t, words) for _, t in rows]
    cell = [(k, k, True, s) for k, s in enumerate(sets)]
    found = jaccard.join_cell(cell, percent, every=True)
    _, links = brute_components(rows, words, percent)
    assert {tuple(sorted(x)) for x in found} == set(links)
    sides = [(k, k, k % 3 == 0, s) for k, s in enumerate(sets)]
    crossed = jaccard.join_cell(sides, percent, every=True)
    assert {tuple(sorted(x)) for x in crossed} == {(a, b) for a, b in links if (a % 3 == 0) != (b % 3 == 0)}


def test_drop_near_copies(spark):
    rows = copies(9)
    docs = spark.createDataFrame([doc(*r) for r in rows + rows[:5]], DOCS)
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    expected, _ = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({eval(e)[2] for e in expected})


def test_connected_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (100, 100), (7, 7), (200, 150), (150, 200)]
    edges = spark.createDataFrame(chain, "a long, b long")
    # at once, by rounds to the end, and by rounds until few edges are left
    for local in (1000, 0, 20):
        found = {r.node: r.component for r in connected_components(edges, local).collect()}
        assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 150: 150, 200: 150}
        assert connected_components(edges.where("false"), local).count() == 0
