"""Mixing, packing, token counts, chat, near-duplicates, media and the pipeline."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_agrees
from pyspark.sql import functions as F

import corpus_pipeline
from scoreframe.llm import chat, components, media, mixing, near_dedup, packing, token_counts, toxicity, webp
from scoreframe.llm.components import connected_components
from scoreframe.llm.tokenize import WordTokenizer, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, "s", "x"), (2, "", None, "x"), (3, " \n ", "s", "x"), (3, " \n ", "s", "x"), (4, "a b", "s", None), (5, "word " * 30_000, "t", "x"), (None, "some words here", None, "x"), (7, "a B", "s", "x")]
DOCS = "doc_id long, text string, source string, size string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- mixing


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def check_mix(spark, docs):
    rows = mixing.mix(docs).collect()
    given = docs.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in given:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = targets(sizes)
    assert len(rows) == len(given)
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    return rows


def test_mix(spark, odd):
    first = check_mix(spark, documents(spark))
    again = mixing.mix(documents(spark).repartition(7)).collect()
    key = lambda rows: sorted((r.doc_id, r.taken, r.position or -1) for r in rows)
    assert key(first) == key(again)
    check_mix(spark, odd)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.take(odd.limit(0)).count() == 0


def test_schedule_is_inverted(spark):
    knots = ((0.0, 0.2), (0.5, 1.0), (1.0, 1.8))
    grid = spark.range(101).select((F.col("id") / 100).alias("q"))
    got = [r[0] for r in grid.orderBy("q").select(mixing.when_met(F.col("q"), knots)).collect()]
    u = np.array(got)
    area = np.where(u <= 0.5, 0.2 * u + 0.8 * u * u, 0.3 + (u - 0.5) + 0.8 * (u - 0.5) ** 2)
    assert np.allclose(area / 1.0, np.linspace(0, 1, 101), atol=1e-9) and (np.diff(u) > 0).all()


def test_take_repeats_documents(spark):
    docs = documents(spark)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = {}
    for r in mixing.take(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: c for d, c in copies.items() if c}


def test_take_odd_rows(spark):
    """Null and repeated ids, equal rows, clashing and map columns: each row is taken as often as its own copies say."""
    rows = [(None, f"text {'w ' * (i % 5)}", "s" if i % 3 else "t", "c") for i in range(40)] + [(7, "a b c", "t", "c"), (7, "a b c", "t", "c"), (7, "x y", "t", None), (8, None, None, "c"), (9, "", "s", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _position string").withColumns({"row_key": F.lit("mine"), "_one": F.create_map(F.lit("k"), F.lit(1))})
    got = mixing.take(docs)
    assert got.columns == docs.columns and {r.row_key for r in got.collect()} == {"mine"}
    words = {}
    for r in got.collect():
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text or ""))
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = targets(sizes)
    assert all(abs(words.get(s, 0) - want[s]) <= 5 for s in sizes)
    assert mixing.take(docs.limit(0)).count() == 0


def test_many_sources_agree(spark):
    """Targets over several hundred sources, null among them."""
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 389}" if i % 389 else None) for i in range(1200)]
    check_mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))


def test_every_epoch_has_its_position(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i j", "s" if i < 40 else "t") for i in range(400)], DOCS.replace(", size string", ""))
    mixed = {r.doc_id: r.asDict() for r in mixing.mix(docs).collect()}
    grid = np.linspace(0, 1, 100_001)
    area = {"s": 1.5 * grid - grid**2 / 2, "t": np.where(grid <= 0.5, 0.2 * grid + 0.8 * grid**2, 0.3 + (grid - 0.5) + 0.8 * (grid - 0.5) ** 2)}
    want = []
    for d, r in mixed.items():
        for copy in range(r["copies"]):
            middle = min(1, (r["offset"] + copy * r["source_size"] + r["size"] / 2) / r["target"])
            want.append((np.interp(middle, area[r["source"]] / area[r["source"]][-1], grid), d))
    got = [r.doc_id for r in mixing.take(docs).collect()]
    assert {r["copies"] for r in mixed.values() if r["source"] == "s"} == {2} and len(got) == len(want)
    assert got == [d for _, d in sorted(want)]
    assert sum(d < 40 for d in got[: len(got) // 2]) > 40  # the repeated source that fades out gives most of its words early


# --- packing and token counts


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("text", ["A, b. C!! d's don't", "x<|endoftext|>y <|startoftext|>", "é́ É\u00a0Ñ\u2003q ß İ Σς", "a\x0bb\x0cc\x1cd\u0085e", "1234 5.6,7", "", " ", "…, word., (x.)", "日本 語。"])
def test_pieces_are_what_the_tokenizer_gives(text):
    got = np.frombuffer(WordTokenizer(tokenizer_path()).encode(text), "<u2").tolist()
    assert got == whole_tokenizer().encode(text, add_special_tokens=False).ids


def check_packing(spark, docs):
    tokenizer = whole_tokenizer()
    pieces = packing.pack(docs).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, tuple(ids_of(tokenizer, r.text))) for r in docs.select("doc_id", "text").collect())
    sequences, per = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        per.setdefault((p.doc_id is None, p.doc_id or 0), []).append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    for key, group in itertools.groupby(want, key=lambda w: w[:2]):
        texts = [np.array(w[2], "<u4") for w in group]
        got = per.pop(key)
        assert sum(p.length for p in got) == sum(len(t) for t in texts)
        if len(texts) == 1:  # gapless from the start
            at = 0
            for p in sorted(got, key=lambda p: p.start):
                assert p.start == at
                at += p.length
        for p in got:
            assert any(len(t) == p.doc_tokens and zlib.crc32(t[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for t in texts)
    assert not per
    return sequences


def test_packing(spark, odd):
    sequences = check_packing(spark, documents(spark))
    used = sum(n for parts in sequences.values() for _, n in parts)
    assert used / (4096 * len(sequences)) > 0.9
    check_packing(spark, odd)
    assert packing.pack(odd.limit(0)).count() == 0


def best_by_force(tails, i, unused):
    """BM25 of all unused tails for the distinct ids of tail i, term by term."""
    n, mean = len(tails), sum(map(len, tails)) / len(tails)
    scores = {}
    for j in unused:
        total = 0.0
        for term in set(tails[i].tolist()):
            f = int((tails[j] == term).sum())
            df = sum(bool((t == term).any()) for t in tails)
            if f and df > 1:
                total += np.log1p((n - df + 0.5) / (df + 0.5)) * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(tails[j]) / mean))
        if total > 0:
            scores[j] = total
    return scores


def test_neighbours_by_force():
    r = np.random.default_rng(0)
    tails = [r.integers(1, 400, r.integers(3, 60)).astype("<u2") for _ in range(40)]
    index, unused = packing.Index(tails), set(range(40))
    for i in r.permutation(40)[:35].tolist():
        unused.discard(i)
        index.drop(i)
        want = best_by_force(tails, i, unused)
        got = index.neighbours(tails[i]).tolist()
        assert set(got) == set(want)
        assert [want[j] for j in got] == pytest.approx(sorted(want.values(), reverse=True))


def test_neighbours_share_windows():
    r = np.random.default_rng(0)
    topics = [np.arange(i * 1000, i * 1000 + 200, dtype="<u2") for i in range(4)]
    tails = [r.choice(topics[i % 4], 512) for i in range(32)]
    windows = packing.pack_shard(tails, window=4096)
    assert sorted((i, p) for w in windows for i, a, b in w for p in range(a, b)) == [(i, p) for i in range(32) for p in range(512)]
    assert all(len({i % 4 for i, _, _ in w}) == 1 for w in windows)


def test_every_unused_neighbour_is_found():
    """Groups of far more than a window's tails, each tail with many ids of its own."""
    r = np.random.default_rng(1)
    own = iter(range(10_000, 60_000))
    tails = [np.array([*r.choice(np.arange(t * 100, t * 100 + 60), 50), *itertools.islice(own, 30)], "<u2") for t in [0, 1, 2, 3] * 120]
    windows = packing.pack_shard(tails, window=800)
    assert sorted((i, p) for w in windows for i, a, b in w for p in range(a, b)) == [(i, p) for i in range(480) for p in range(80)]
    assert sum(len({i % 4 for i, _, _ in w}) > 1 for w in windows) <= 3


@pytest.mark.parametrize("block", [257, token_counts.BLOCK])
def test_token_counts(spark, odd, tmp_path, block):
    tokenizer = whole_tokenizer()
    tokenizer.encode_special_tokens = True
    for k, docs in enumerate((documents(spark), odd)):
        folder = f"{tmp_path}/{k}"
        names = token_counts.write_flat_files(docs, folder).withColumnsRenamed({"file": "name", "doc_no": "no"})
        counted = token_counts.count_tokens(spark, folder, block=block)
        joined = names.join(counted, (F.col("name") == F.substring_index("file", "/", -1)) & (F.col("no") == F.col("doc_no")))
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in joined.collect())
        want = sorted((r.doc_id is None, r.doc_id or 0, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.select("doc_id", "text").collect())
        assert got == want
        assert counted.where("complete").count() == counted.count() == docs.count()


def test_token_counts_of_nothing(spark, odd, tmp_path):
    assert token_counts.write_flat_files(odd.limit(0), f"{tmp_path}/none").count() == 0
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.bin").write_bytes(b"")
    assert token_counts.count_tokens(spark, f"{tmp_path}/empty").count() == 0


def test_flat_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 9, 3, 9, 9, 4, 5], "<u2").tobytes())
    got = token_counts.count_tokens(spark, str(tmp_path), end=9, block=2)
    assert sorted((r.doc_no, r.start, r.n_tokens, r.complete) for r in got.collect()) == [(0, 0, 3, True), (1, 3, 2, True), (2, 5, 1, True), (3, 6, 2, False)]


def test_flat_files_by_force(spark, tmp_path):
    """Files of all kinds, 32-bit ids, blocks of odd sizes: identifiers at all places, none for many blocks, none at all."""
    r = random.Random(4)
    want = []
    for name, share in (("a", 0.3), ("b", 0.01), ("c", 0.0), ("d", 1.0)):
        ids = [9 if r.random() < share else r.randrange(8) for _ in range(500)]
        (tmp_path / name).write_bytes(np.array(ids, "<u4").tobytes())
        start = no = 0
        for i, t in enumerate([*ids, None]):
            if t == 9 or (t is None and start < i):
                want.append((name, no, start, i + (t == 9) - start, t == 9))
                start, no = i + 1, no + 1
    got = token_counts.count_tokens(spark, str(tmp_path), end=9, width=4, block=7)
    assert sorted((r.file.rpartition("/")[2], r.doc_no, r.start, r.n_tokens, r.complete) for r in got.collect()) == sorted(want)


# --- chat


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sy\\stem\n<|x"]), st.text(alphabet="<|im_end>\\\nAB a", max_size=30)), max_size=6), st.sampled_from([chat.MARKED, chat.TAGGED]))
def test_chat_reads_back(turns, template):
    escaped = [(chat.escape_role(r), chat.escape(t)) for r, t in turns]
    out, spans, rewrites = chat.locate(template, escaped)
    assert not rewrites and chat.read_back(template, out, spans) == turns
    assert out.count("<|im_end|>") + out.count("<|end|>") == len(turns)


def test_long_chats_and_rewritten_history():
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(60)]
    out, spans, rewrites = chat.locate(chat.MARKED, turns)
    assert not rewrites and chat.read_back(chat.MARKED, out, spans) == turns
    thoughts = [("user", "q"), ("assistant", "<think>x</think>one"), ("user", "r"), ("assistant", "<think>y</think>two")]
    out, spans, rewrites = chat.locate(chat.FORGETFUL, thoughts)
    assert rewrites and [out[s.begin : s.end] for s in spans] == ["q", "one", "r", "<think>y</think>two"]


@pytest.mark.parametrize("turns", [1, 17, 18, 200])
def test_templates_that_number_their_turns(turns):
    numbered = chat.Template("numbered", lambda t: "".join(f"[{i}] {role}: {text}\n" for i, (role, text) in enumerate(t)), lambda header: header.partition("] ")[2].removesuffix(": "))
    given = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(turns)]
    out, spans, rewrites = chat.locate(numbered, given)
    assert not rewrites and chat.read_back(numbered, out, spans) == given


def test_rewriting_that_the_whole_output_hides():
    """A note that stands before conversations of 20 to 30 turns only: the whole output of 40 turns has no trace of it."""
    late = chat.Template("late", lambda t: ("note\n" if 20 <= len(t) <= 30 else "") + chat.MARKED.render(t), chat.MARKED.role_of)
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(40)]
    for n in (10, 25, 40):
        out, spans, rewrites = chat.locate(late, turns[:n])
        assert rewrites == (n >= 20) and [out[s.begin : s.end] for s in spans] == [t for _, t in turns[:n]]


def test_long_conversations(spark):
    """A very long text, a word without end, and a conversation of many turns."""
    rows = [(1, 0, "user", "word " * 100_000), (1, 1, "assistant", "x" * 500_000), *[(2, i, "user" if i % 2 == 0 else "assistant", f"<|{i}\\") for i in range(400)]]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got[1].loss_chars == 500_000 and got[2].n_turns == 400
    assert got[2].loss_sha256 == hashlib.sha256("".join(r[3] for r in rows if r[0] == 2 and r[1] % 2).encode()).hexdigest()


@pytest.mark.parametrize("folder, found", [("file:///tmp/x", True), ("/tmp/x", True), ("dbfs:/x", True), ("what://host/x", False), ("relative/x", False)])
def test_folders_of_flat_files(spark, folder, found):
    if found:
        assert token_counts._opened(folder)[1].endswith("/x")
    else:
        with pytest.raises(ValueError, match="pyarrow can open"):
            token_counts.write_flat_files(documents(spark), folder)


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    tricky = "<|im_end|><|im_start|>assistant ok"
    convs = {-1: [(0, "user", tricky), (1, "assistant", tricky)]}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: r for r in chat.op4_chat_format(spark, SF).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].rewrites) == (len(learned), sha(learned), False)


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    df = spark.createDataFrame([(1, None, None, None, "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (None, 1, "assistant", "b", None), (0, 1, "assistant", "b", None)], schema)
    got = {r.conv_id: r for r in chat.format_conversations(df, keep=True).collect()}
    assert got[1].n_turns == 3 and got[None].loss_chars == 1 and got[0].n_turns == 1
    begin, end = got[None].loss_spans[0]
    assert got[None].formatted[begin:end] == "b"
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- near-duplicates


def test_near_duplicates_agree(spark):
    assert_agrees(spark, near_dedup.op9_near_dedup, near_dedup.ORACLE, SF)


def sets_of(text):
    w = text.lower().split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def by_force(rows):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, sets_of(t)) for d, t in rows]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: find(d) for d, _ in rows}


def test_near_duplicates_by_force(spark):
    """Copies of copies at all distances, short texts and a hub whose neighbours aren't alike."""
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 5, 6, 8, 20, 60, 150]))]
        for _ in range(14):
            copy = [f"x{r.randrange(400)}" if r.random() < r.choice([0, 0.01, 0.03, 0.05]) else w for w in base]
            rows.append((len(rows), " ".join(copy[: len(copy) - r.choice([0, 0, 1])]).upper() if r.random() < 0.2 else " ".join(copy)))
    got = {x.doc_id: x.component_id for x in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == by_force(rows)


def test_blocks_find_what_the_hub_misses(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(40):  # far from each other, in pairs of close ones
        far = [f"y{k}_{i}" if r.random() < 0.06 else w for i, w in enumerate(base)]
        rows += [(2 * k, " ".join(far)), (2 * k + 1, " ".join([*far[:60], "z", *far[61:]]))]
    got = {x.doc_id: x.component_id for x in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == by_force(rows)


def test_first_shared_bucket_is_told_by_its_key(spark):
    """Bins that agree by chance in a band before the first shared bucket don't lose the pair; it leaves from one bucket only."""
    keys = [list(range(near_dedup.BANDS)), [-1, -1, -1, *range(3, near_dedup.BANDS)]]
    small = bytearray(bytes(near_dedup.BINS))
    schema = "key long, band int, id long, n int, component long, small binary, keys array<long>"
    for band, found in ((3, [(1, 2)]), (7, [])):
        rows = [(band, band, i, 100, i, small, k) for i, k in zip((1, 2), keys, strict=True)]
        assert [tuple(r) for r in near_dedup.compare_rest(spark.createDataFrame(rows, schema)).collect()] == found


def test_near_duplicates_odd_rows(spark, odd):
    rows = near_dedup.link(odd).collect()
    assert len(rows) == len(ODD)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (7, 1, 4, False), (5, 1, 5, True), (None, 1, None, True)} == got
    assert near_dedup.link(odd.limit(0)).count() == 0


def test_ids_that_repeat(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(4, x), (7, x), (7, y), (7, y.upper()), (7, y), (9, z), (12, z), (11, y), (11, z), (15, None), (15, "q r"), (None, x), (20, "solo text"), (20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.link(docs).collect())
    assert {c for d, c, _ in got if d in (4, 7, 9, 11, 12)} == {4} and {d for d, _, k in got if k} == {0, 4, 15, 20} and len(got) == len(rows)
    kept = sorted((r.doc_id or 0, r.text or "") for r in near_dedup.keep_one(docs.withColumn("_gone", F.lit(1))).collect())
    one = y.upper() if (7, y.upper()) in kept else y
    assert kept == sorted([(0, x), (4, x), *[(7, one)] * (2 if one == y else 1), (9, z), (15, ""), (15, "q r"), (20, "solo text"), (20, "")])


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in low:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low


@pytest.mark.parametrize(("edges", "steps"), [([(k - k % 10, k) for k in range(40)], 0), ([(99 - k % 10, k) for k in range(60)], 1), ([], 0)])
def test_components_end_when_all_are_stars(spark, monkeypatch, edges, steps):
    """A step writes four tables; one more tells that none is left to do."""
    written, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or write(df, name))
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: 99 - v if v > 89 else v % 10 if steps else v - v % 10 for e in edges for v in e}
    assert written == ["low", "edges", "low", "edges"] * steps + ["low"]


# --- media


def put(*numbers):
    """A stream of (value, width) pairs."""
    out = webp.Writer()
    for value, width in numbers:
        out.put(value, width)
    return out


def file_of(out):
    return webp.wrap(out.bytes())


def begun(width, height):
    return put((width - 1, 14), (height - 1, 14), (1, 1), (0, 3))


def plain_image(out, pixels, top):
    """An image of ARGB pixels without a cache: codes of the values that occur, pixels one by one."""
    out.put(0, 1 + top)
    channels = [pixels >> s & 255 for s in (8, 16, 0, 24)]
    lengths = [webp.code_lengths(np.bincount(c, minlength=280 if k == 0 else 256)) for k, c in enumerate(channels)]
    for n in [*lengths, np.zeros(40, np.int64)]:
        webp._put_code(out, n)
    codes = [webp._code_of(n) for n in lengths]
    for row in zip(*channels, strict=True):
        for v, (code, width) in zip(row, codes, strict=True):
            out.put(int(code[v]), int(width[v]))


def picture(height=6, width=7, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 4)).astype(np.int64)


def guess_of(image, y, x, mode):
    """The published prediction for one pixel, channel by channel."""
    if y == 0:
        return [255, 0, 0, 0] if x == 0 else image[0, x - 1]
    if x == 0:
        return image[y - 1, 0]
    left, up, corner = (image[y, x - 1].astype(int), image[y - 1, x].astype(int), image[y - 1, x - 1].astype(int))
    right = (image[y - 1, x + 1] if x + 1 < image.shape[1] else image[y, 0]).astype(int)
    mean = lambda a, b: (a + b) // 2
    if mode == 11:
        p = left + up - corner
        return left if abs(p - left).sum() < abs(p - up).sum() else up
    half = lambda v: np.trunc(v / 2).astype(int)
    return [
        np.array([255, 0, 0, 0]), left, up, right, corner, mean(mean(left, right), up), mean(left, corner), mean(left, up), mean(corner, up), mean(up, right),
        mean(mean(left, corner), mean(up, right)), None, np.clip(left + up - corner, 0, 255), np.clip(mean(left, up) + half(mean(left, up) - corner), 0, 255),
    ][mode]


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    image = picture()
    rest = np.stack([[(image[y, x] - guess_of(image, y, x, mode)) & 255 for x in range(7)] for y in range(6)])
    out = begun(7, 6)
    for value, width in ((1, 1), (webp.PREDICTOR, 2), (0, 3)):
        out.put(value, width)
    plain_image(out, np.full(4, 255 << 24 | mode << 8), False)
    out.put(0, 1)
    plain_image(out, webp._joined(rest).reshape(-1), True)
    assert (webp.decode(file_of(out)) == image).all()


def test_webp_colour_transforms():
    image = picture(seed=1)
    signed = lambda v: v - ((v & 128) << 1)
    a, r, g, b = image.transpose(2, 0, 1)
    gr, gb, rb = 33, 200, 77
    crossed = np.stack([a, (r - (signed(gr) * signed(g) >> 5)) & 255, g, (b - (signed(gb) * signed(g) >> 5) - (signed(rb) * signed(r) >> 5)) & 255], axis=-1)
    lessened = crossed - crossed[..., 2:3] * np.array([0, 1, 0, 1]) & 255
    out = begun(7, 6)
    for value, width in ((1, 1), (webp.CROSS_COLOUR, 2), (0, 3)):
        out.put(value, width)
    plain_image(out, np.full(4, 255 << 24 | rb << 16 | gb << 8 | gr), False)
    for value, width in ((1, 1), (webp.SUBTRACT_GREEN, 2), (0, 1)):
        out.put(value, width)
    plain_image(out, webp._joined(lessened).reshape(-1), True)
    assert (webp.decode(file_of(out)) == image).all()


def simple(*symbols):
    """A simple code's bits."""
    return [(1, 1), (len(symbols) - 1, 1), (1, 1), *[(s, 8) for s in symbols]]


def test_webp_back_references_and_cache():
    red, blue = (255, 10, 3, 20), (255, 30, 3, 20)
    value = lambda p: p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]
    slot = lambda p: (0x1E35A7BD * value(p) & 0xFFFFFFFF) >> 31
    lengths = np.zeros(282, np.int64)
    lengths[[3, 256 + 4, 280, 281]] = 1, 2, 3, 3  # literal, length 5 or 6, two cache entries
    code, wide = webp._code_of(lengths)
    sent = lambda s: (int(code[s]), int(wide[s]))
    out = begun(4, 2)
    for pair in ((0, 1), (1, 1), (1, 4), (0, 1)):
        out.put(*pair)
    webp._put_code(out, lengths)
    last = {slot(red): red} | {slot(blue): blue}
    for pair in [*simple(10, 30), *simple(20), *simple(255), *simple(1), sent(3), (0, 1), sent(3), (1, 1), sent(280 + slot(red)), sent(256 + 4), (0, 1)]:
        out.put(*pair)
    assert [tuple(p) for p in webp.decode(file_of(out)).reshape(-1, 4).tolist()] == [red, blue, last[slot(red)], *[last[slot(red)]] * 5]


def test_webp_meta_codes_and_bundles():
    out = begun(5, 3)
    groups = [(1, 1), (0, 3), (0, 1), *simple(0), *simple(0), *simple(0), *simple(255), *simple(0)]
    for pair in [(0, 1), (0, 1), *groups, *simple(7), *simple(8), *simple(9), *simple(255), *simple(0)]:
        out.put(*pair)
    assert (webp.decode(file_of(out)) == [255, 8, 7, 9]).all()
    # two groups by column: the left tile's pixels are 7, the right one's 9
    out = begun(8, 2)
    both = [*simple(0), *simple(0), *simple(255), *simple(0)]
    for pair in [(0, 1), (0, 1), (1, 1), (0, 3), (0, 1), *simple(0, 1), *both, (0, 1), (1, 1), *simple(7), *both, *simple(9), *both]:
        out.put(*pair)
    assert webp.decode(file_of(out))[..., 2].tolist() == [[7] * 4 + [9] * 4] * 2
    out = begun(9, 1)
    table = [(0, 1), *simple(0, 5), *simple(0), *simple(0), *simple(0, 255), *simple(0), (0, 1), (1, 1), (1, 1), (0, 1)]  # greens 0 and 5
    for pair in [(1, 1), (webp.PALETTE, 2), (1, 8), *table, (0, 1), (0, 2), *simple(0b10110010, 1), *simple(0), *simple(0), *simple(255), *simple(0), (1, 1), (0, 1)]:
        out.put(*pair)
    assert webp.decode(file_of(out))[0, :, 2].tolist() == [0, 5, 0, 0, 5, 5, 0, 5, 5]


def test_webp_of_another_encoder():
    """A published one-pixel file, as it is and in the extended container."""
    one = bytes.fromhex("524946461a000000574542505650384c0d0000002f00000010071011118888fe0700")
    assert webp.decode(one).tolist() == [[[0, 0, 0, 0]]]
    extended = b"WEBPVP8X" + (10).to_bytes(4, "little") + bytes(10) + one[12:]
    assert webp.decode(b"RIFF" + len(extended).to_bytes(4, "little") + extended).tolist() == [[[0, 0, 0, 0]]]


@pytest.mark.parametrize("broken", [b"", b"RIFFxxxxWEBPVP8 abcd", bytes.fromhex("524946461a000000574542505650384c0d0000002f000000100710111188"), bytes.fromhex("524946461a000000574542505650384c050000002fffffff0f")])
def test_broken_files_are_refused(broken):
    with pytest.raises(ValueError):
        webp.decode(broken)


def kinds_of(stored):
    """The transforms that a file's stream names first."""
    bits = webp.Bits(stored[21:])
    bits.read(32)
    return bits.read(2) if bits.read(1) else None


def test_encoder_uses_what_helps():
    r = np.random.default_rng(3)
    noise = r.integers(0, 256, (30, 192, 3)).astype(np.uint8)
    slope = np.cumsum(r.integers(0, 3, (30, 192, 3)), axis=1).astype(np.uint8)
    grey = noise[..., :1] + r.integers(0, 4, (30, 192, 3)).astype(np.uint8)
    few = noise[:1, :, :1] // 64 * np.ones((20, 1, 3), np.uint8)
    words = np.frombuffer(" ".join(r.choice(["some", "words", "that", "come", "again"], 2000)).encode()[: 576 * 12], np.uint8).reshape(12, 192, 3)
    for image, want in ((noise, None), (slope, webp.PREDICTOR), (grey, webp.CROSS_COLOUR), (few, webp.PALETTE), (words, None)):
        stored = webp.encode(image)
        assert (webp.decode(stored)[..., 1:] == image).all() and stored == webp.encode(image.copy())
        assert want is None or kinds_of(stored) == want
    assert len(webp.encode(words)) < words.size // 3  # copies and the cache, not codes alone


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.sampled_from([1, 2, 3, 17, 256]), st.sampled_from([0.0, 0.5, 0.98]))
def test_webp_round_trip(seed, height, values, again):
    r = np.random.default_rng(seed)
    flat = r.integers(0, values, height * 192 * 3).astype(np.uint8)
    for at in np.flatnonzero(r.random(len(flat)) < again / 50):
        back, n = int(r.integers(1, at + 2)), int(r.integers(1, 400))
        flat[at : at + n] = np.resize(flat[max(0, at - back) : at + 1], len(flat[at : at + n]))
    image = flat.reshape(height, 192, 3)
    assert (webp.decode(webp.encode(image))[..., 1:] == image).all()


def varied(many, seed=5):
    """Payloads of one to thirty rows, of few or many values, with copies, slopes and grey stretches."""
    r, out = np.random.default_rng(seed), []
    for k in range(many):
        flat = r.integers(0, r.choice([1, 2, 4, 17, 60, 256]), int(r.integers(1, 30)) * 576).astype(np.uint8)
        for at in r.integers(0, len(flat), 6):
            back, n = int(r.integers(1, at + 2)), int(r.integers(1, 900))
            flat[at : at + n] = np.resize(flat[max(0, at - back) : at + 1], len(flat[at : at + n]))
        flat = np.cumsum(flat % 3).astype(np.uint8) if k % 5 == 0 else np.repeat(flat[::3], 3) if k % 7 == 0 else flat
        out.append(flat.tobytes())
    return out


def test_pictures_together_are_as_alone():
    payloads = varied(120)
    together = media.store_all(payloads)
    assert together == [media.store(p) for p in payloads]
    assert {kinds_of(s) for s in together} >= {None, webp.PREDICTOR, webp.PALETTE}
    assert [b"".join(p.tobytes() for p in x) for x in media.load_all(together)] == payloads
    assert all(b"".join(p.tobytes() for p in media.load(s)) == payload for s, payload in zip(together, payloads, strict=True))
    with pytest.raises(ValueError):
        webp.decode_all([s[:-40] for s in together if len(s) > 200])
    assert media.store_all([]) == [] and media.load_all([]) == []


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=2000))
def test_media_round_trip(text):
    payload, size = media.payload_of(text)
    assert payload[:size] == text.encode("utf-8", "replace") and set(payload[size:]) <= {255} and len(payload) % 576 == 0 and payload
    assert b"".join(p.tobytes() for p in media.load(media.store(payload))) == payload


def test_large_payloads():
    payload = bytes(range(256)) * (576 * 4096 // 256) + b"\xff" * 576
    pictures = media.load(media.store(payload))
    assert b"".join(p.tobytes() for p in pictures) == payload and len(pictures) == 2
    assert media.describe(pictures) != media.describe([pictures[0], pictures[1] - 1])


def test_long_texts_stay_one_picture():
    payloads = [bytes(r) * 4096 * 3 for r in ([7] * 192, range(192))] + varied(40)
    assert [len(x) for x in media.load_all(media.store_all(payloads))] == [1] * len(payloads)


def test_copies_read_together_are_as_alone(monkeypatch):
    """Short and long, overlapping and far back-references of many files, read in step and one by one."""
    files = [f for payload in varied(60, 11) for f in [media.store(payload)]]
    found = []
    for few in (0, 10**9):
        monkeypatch.setattr(webp, "FEW_COPIES", few)
        found.append([d.tobytes() for d in webp.decode_all(files)])
    assert found[0] == found[1]
    with pytest.raises(ValueError):
        monkeypatch.setattr(webp, "FEW_COPIES", 0)
        webp.decode_all([f[:-40] for f in files if len(f) > 200])


def test_media_query(spark, odd):
    for docs in (documents(spark), odd):
        got = media.media_columns(docs, keep_media=True).collect()
        texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.select("doc_id", "text").collect())
        assert len(got) == len(texts)
        for r, (_, _, text) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), texts, strict=True):
            payload, size = media.payload_of(text)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (size, len(payload), hashlib.sha256(payload).hexdigest())
            assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(r.media), hashlib.sha256(r.media).hexdigest())
    assert media.media_columns(odd.limit(0)).count() == 0


# --- pipeline


def sizes_and_cleaned(text):
    """The words of a text's good lines, by the rules as they are stated, and whether the text is kept."""
    from scoreframe.llm.quality_rules import LineRules

    rules, good, n_good = LineRules(), [], 0
    for line in (text or "").split("\n"):
        n = len(WORD.findall(line))
        bad = n > 0 and (
            (n <= rules.boilerplate_words and re.search(rules.boilerplate, line.lower()) is not None)
            or sum(line.count(c) for c in rules.separators) >= rules.max_separators
            or sum(line.count(c) for c in "#*$%&|<>") > rules.max_symbols_per_word * n
            or (n >= rules.shout_words and sum("A" <= c <= "Z" for c in line) > rules.max_shout_share * len(line.replace(" ", "")))
            or (n >= rules.punctuation_words and not any(c in line for c in rules.punctuation))
        )
        if not bad:
            good.append(line)
            n_good += n
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    repeated = len({p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 5)})
    kept = len(words) >= rules.min_words and 100 * repeated <= rules.max_repeat_percent * len(words) and not len(words) - n_good > rules.max_lost_share * len(words)
    return "\n".join(good), kept


def test_pipeline(spark):
    docs = documents(spark)
    columns, now = docs.columns, docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = corpus_pipeline.materialize(stage(spark, before, SF), "stage")
        seen.append(now)
        if name != "packing":
            assert now.columns == columns
        if name == "toxicity":
            scored = toxicity.score_toxicity(before, toxicity.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
            assert sorted(r.doc_id for r in now.collect()) == sorted(r.doc_id for r in scored if r.score < 0.5)
        if name == "quality rules":
            told = {r.doc_id: sizes_and_cleaned(r.text) for r in before.collect()}
            assert {r.doc_id: (r.text, r.n_chars) for r in now.collect()} == {d: (t, len(t)) for d, (t, kept) in told.items() if kept}
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            force = by_force(rows)
            assert {r.doc_id for r in now.collect()} == {d for d, c in force.items() if d == c}
        if name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
            got = {}
            for r in now.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert got == copies
    mixed, packed = seen[3:]
    tokenizer = whole_tokenizer()
    assert packed.agg(F.sum("length")).first()[0] == sum(len(ids_of(tokenizer, r.text)) for r in mixed.collect())
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(packed)


def test_stages_keep_what_is_not_theirs(spark):
    """Null ids, texts and sources, equal rows, long texts, empty tables and columns of all names that stages use."""
    good = "This is a plain sentence of quite a few words, and it ends well."
    rows = [(1, None, "s"), (2, "", None), (3, good, "s"), (3, good, "s"), (None, f"{good} Nobody has an id here.", None), (5, "word " * 20_000, "s"), (6, "x" * 100_000, "t"), (7, good, "t"), (7, f"{good}\nAnother line, which no other text has at all.", "t")]
    names = ["score", "_toxicity", "kept", "cleaned", "n_words", "_w", "_lines", "_gone", "_gone_text", "_copies", "_position", "_id", "row", "row_key", "key", "position", "digest", "a.b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and none.columns == docs.columns
        now = corpus_pipeline.materialize(stage(spark, now, SF).toDF(*[c.replace(".", "_") for c in docs.columns]), "stage").toDF(*docs.columns)
        got = now.collect()
        assert now.columns == docs.columns and all(r[n] == n for r in got for n in names), name
        if name == "toxicity":
            assert len(got) == len(rows)
        if name == "quality rules":
            assert sorted(r.doc_id or 0 for r in got) == [0, 3, 3, 7, 7]
        if name == "near duplicates":
            assert sorted(r.doc_id or 0 for r in got) == [0, 3, 3, 7]
    assert corpus_pipeline.pack_windows(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.pack_windows(spark, docs, SF).select("doc_id", "start").distinct().count() >= 6
