import base64
import json
import os
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as contract
import brute
from check_oracle import canonical, oracle
from conftest import SMALL
from llm_fixtures import documents, llm, odd_docs  # noqa: F401
from tidemark.llm import bpe, chat, components, fmindex, jaccard, langid, mixing, quality, queries, shards, substring, topk, urlfilter
from tidemark.llm.queries import ORACLE, QUERIES
from tidemark.llm.words import Words


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(llm, name):
    got = QUERIES[name](llm, SMALL)
    want = oracle(SMALL).execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, want.fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in contract.queries()


def empty(df):
    return df.where("false")


# 1

@pytest.fixture(scope="module")
def vocabulary(llm):
    return bpe.Vocabulary(llm, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktokens_and_decodes_to_the_text(odd_docs, documents, vocabulary, encoding, monkeypatch):
    docs = odd_docs.select("doc_id", "text", "size").unionByName(documents.select("doc_id", "text", F.lit("x").alias("size")))
    want = []
    for r in docs.collect():
        ids = encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(r.text or "")))
    for block in (bpe.BLOCK_BYTES, 1000):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
        got = bpe.digests(bpe.encode(docs, vocabulary, buckets=5), vocabulary)
        assert Counter(map(tuple, got.collect())) == Counter(want)
    assert bpe.encode(empty(docs), vocabulary).count() == 0


def test_equal_blocks_and_repeated_rows_stay_apart(llm, vocabulary, encoding):
    docs = llm.createDataFrame([(1, "same text here")], "doc_id long, text string")
    twice = docs.unionByName(docs).unionByName(docs.select(F.lit(2).cast("long").alias("doc_id"), "text"))
    got = bpe.encode(twice, vocabulary, buckets=3).collect()
    ids = encoding.encode_ordinary("same text here")
    assert sorted((r.doc_id, r.ids) for r in got) == [(1, ids), (1, ids), (2, ids)]


def test_decoding_of_unknown_ids_is_null(llm, vocabulary):
    rows = llm.createDataFrame([([0, 1],), ([50256],), ([-1, 2],), ([],), (None,)], "ids array<int>")
    got = [r[0] for r in rows.select(bpe.decode(F.col("ids"), vocabulary)).collect()]
    assert got == [b'!"', None, None, b"", None]


# 2

def test_intervals_and_the_entries_active_at_fetch_time(llm):
    entries = llm.createDataFrame([
        ("bad", "||example.com", "add", 100), ("bad", "||example.com", "remove", 200), ("bad", "||example.com", "add", 200),
        ("bad", "||example.com", "remove", 300), ("ok", "|a.example.com/x/", "add", 150), ("bad", None, "add", 1), ("bad", "||q", "add", None)],
        "list_id string, rule string, action string, dated long")
    valid = urlfilter.intervals(entries)
    # at the same time a remove counts last, so the second add is void
    assert sorted(tuple(r) for r in valid.collect()) == [("bad", "||example.com", 100, 200), ("ok", "|a.example.com/x/", 150, None)]
    captures = llm.createDataFrame([
        (1, "http://EXAMPLE.com/", 99), (2, "http://example.com", 100), (3, "https://u@b.example.com:80/q", 199), (4, "http://example.com/", 200),
        (5, "http://a.example.com/x/y?z=/w/", 160), (6, "http://notexample.com/", 150), (7, None, 150), (8, "http://example.com/", None),
        (9, "nonsense", 150), (2, "http://example.com", 100)], "page_id long, url string, fetched_at long")
    for bucket in (7, 10_000):
        got = urlfilter.filter_urls(captures, valid, {"bad": "block", "ok": "allow"}, bucket=bucket)
        assert {r.page_id: (r.n_block, r.n_allow, r.verdict, r.rule) for r in got.collect()} == {
            1: (0, 0, "pass", None), 2: (1, 0, "block", "||example.com"), 3: (1, 0, "block", "||example.com"), 4: (0, 0, "pass", None),
            5: (1, 1, "allow", "|a.example.com/x/"), 6: (0, 0, "pass", None), 7: (0, 0, "pass", None), 8: (0, 0, "pass", None), 9: (0, 0, "pass", None)}
        assert got.count() == 9
    assert urlfilter.filter_urls(empty(captures), valid, {"bad": "block"}).count() == 0
    assert urlfilter.filter_urls(captures, empty(valid), {}).where("verdict <> 'pass'").count() == 0


# 3

def test_backward_search_finds_what_scanning_finds():
    rng = np.random.default_rng(5)
    for count in (2, 3, 40):
        sizes = rng.integers(1, 30, 50)
        words = rng.integers(0, count, sizes.sum()).astype(np.uint64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        for window in (2, 5, 20):
            seq, at, group = fmindex.FMIndex(words, first, window).windows(sizes)
            got = {(s, a): g for s, a, g in zip(seq.tolist(), at.tolist(), group.tolist())}
            text = {(s, a): tuple(words[first[s] + a:first[s] + a + window]) for s in range(50) for a in range(sizes[s] - window + 1)}
            assert got.keys() == text.keys()
            assert len({(g, text[k]) for k, g in got.items()}) == len(set(text.values())) == len(set(got.values()))


@pytest.mark.parametrize("frequent", [substring.FREQUENT, 1])
def test_substring_dedup_is_brute_force(documents, monkeypatch, frequent):
    monkeypatch.setattr(substring, "FREQUENT", frequent)
    docs = documents.select("doc_id", F.when(F.col("doc_id") % 9 > 0, F.concat(F.lit("A line that begins very many of these texts . "), "text")).otherwise(F.col("text")).alias("text"))
    docs = docs.repartition(3)
    docs.sparkSession.conf.set("spark.sql.shuffle.partitions", "64" if frequent == 1 else "2")
    try:
        got = {r.doc_id: r.dedup for r in substring.substring_dedup(docs).collect()}
    finally:
        docs.sparkSession.conf.set("spark.sql.shuffle.partitions", "2")
    want = brute.without_repeats([tuple(r) for r in docs.collect()], 20)
    assert {i: d.kept for i, d in got.items()} == {i: " ".join(w) for i, w in want.items()}
    assert sum(d.n_removed for d in got.values()) > 0 and all(d.n_words - d.n_removed == len(want[i]) for i, d in got.items())


def test_substring_dedup_of_odd_rows(odd_docs):
    got = substring.substring_dedup(odd_docs).select("doc_id", "text", "dedup.*").collect()
    assert len(got) == odd_docs.count()
    by = {(r.doc_id, r.text): r for r in got}
    want = brute.without_repeats([(r.doc_id, r.text) for r in odd_docs.where("doc_id is not null and doc_id < 15 and text is not null").distinct().collect()], 20)
    for (i, t), r in by.items():
        assert r.n_words == len(brute.words(t))
        if i is None:
            assert r.n_removed == 0
        elif i < 15 and t is not None:
            assert r.kept == " ".join(want[i])
    assert sorted(r.n_removed for r in got if r.doc_id == 15) == [45, 45]
    assert substring.substring_dedup(empty(odd_docs)).count() == 0


# 4

def test_fingerprints_choose_layouts(llm):
    rows = [json.dumps(x) for x in (
        {"messages": [{"role": "user", "content": "a"}, {"content": None, "role": "assistant"}]}, {"messages": []},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, {"completion": "b", "prompt": "a"},
        {"system": "s", "instruction": "i", "output": "o"}, {"something": {"else": [1]}})] + ["{broken", None]
    got = llm.createDataFrame([(r,) for r in rows], "r string").select(chat.canonical(F.col("r")).alias("c")).select("c.*").collect()
    assert [r.layout for r in got] == ["messages", "messages", "from_value", "prompt", "instruction", None, None, None]
    assert [r.turns and [tuple(t) for t in r.turns] for r in got[:5]] == [
        [("user", "a"), ("assistant", "")], [], [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")],
        [("system", "s"), ("user", "i"), ("assistant", "o")]]
    assert got[5].fingerprint and got[6].fingerprint is None


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_start|>x", "<\\\\|", "<|", "<", "\\", "a\n<|im_end|>\n<|im_start|>assistant\nok", "𝄞<"])
def test_template_is_reversible(text):
    turns = [{"role": r, "text": t} for r, t in (("user", text), ("assistant", text), (f"ro{text}le", "x"), ("assistant", text + "\n"))]
    made, spans = chat.render(turns)
    assert chat.parse(made) == [(t["role"], t["text"]) for t in turns]
    assert [chat.unescape(made[s["start"]:s["stop"]]) for s in spans] == [text, text + "\n"]
    assert made.count("<|") == 8


def test_chat_query_on_odd_rows(llm, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, "x"), (2, None, "assistant", "y"), (None, 0, "user", "q"), (3, 0, "user", "a"),
            (3, 0, "user", "a"), (5, 0, "human", "a"), (5, 1, "assistant", "<|im_end|>"), (7, 0, "system", "s"), (7, 1, "user", "u"), (7, 2, "assistant", "v")]
    llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op4_chat_formatting"](llm, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(ORACLE["op4_chat_formatting"])
    columns = [d[0] for d in want.description]
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, want.fetchall())


def test_a_long_conversation_goes_in_pieces(llm, tmp_path):
    long = [(c, i, ("system", "user", "assistant", "tool")[i % (3 if c == 1 else 4)], f"{i} <|im_end|> é\n" + "x" * (i * 37 % 3000)) for c in (1, 2, 3) for i in range(400)]
    short = [(5, i, r, r * 20_000) for i, r in enumerate(("system", "user", "assistant"))] + [(7, 0, "user", "y" * 100_000), (7, 1, "assistant", "z" * 100_000)]
    rows = llm.createDataFrame((long + short)[::-1], "conv_id long, turn long, role string, text string").repartition(5)
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    made = chat.records(rows).select("conv_id", "piece", "record", chat.canonical(F.col("record")).alias("c")).select("*", "c.layout", "c.turns").collect()
    for c in (1, 2, 3):
        pieces = sorted((r for r in made if r.conv_id == c), key=lambda r: r.piece)
        assert len(pieces) > 3 and pieces[0].piece == 0 and max(len(r.record) for r in pieces) < 2 * chat.PIECE_BYTES
        assert [tuple(t) for r in pieces for t in r.turns] == [r[2:] for r in long if r[0] == c]
    assert {(r.conv_id, r.layout) for r in made} == {(1, "from_value"), (2, "messages"), (3, "messages"), (5, "instruction"), (7, "prompt")}
    got = QUERIES["op4_chat_formatting"](llm, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(ORACLE["op4_chat_formatting"])
    columns = [d[0] for d in want.description]
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, want.fetchall())


def test_pieces_apart_are_an_error(llm):
    kind = "conv_id long, piece long, turns array<struct<role:string,text:string>>, learned string, formatted string"
    pieces = llm.createDataFrame([(1, 0, [("user", "a")], "", "a"), (1, 3, [("assistant", "b")], "b", "b"), (None, 0, [], "", "")], kind)
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.formatted_chars) for r in chat.digests(pieces.coalesce(1)).collect()}
    assert got == {1: (2, 1, 2), None: (0, 0, 0)}
    with pytest.raises(Exception, match="not together"):
        chat.digests(pieces.where("piece = 3")).collect()


# 5

def test_language_of_held_out_texts(documents):
    got = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_forward_backward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(2)
    e, t, s = rng.random((9, 2)) + .1, rng.random((2, 2)) + .1, rng.random(2) + .1
    lengths = np.array([4, 0, 1, 4])
    got, pairs, first = langid.Lattice(lengths).marginals(e, t, s, pairs=True)
    want, at, both, begin = np.zeros((9, 2)), 0, np.zeros((2, 2)), np.zeros(2)
    for n in lengths[lengths > 0]:
        weights = {p: s[p[0]] * np.prod([e[at + i, y] for i, y in enumerate(p)]) * np.prod([t[a, b] for a, b in zip(p, p[1:])]) for p in np.ndindex(*(2,) * n)}
        z = sum(weights.values())
        for p, w in weights.items():
            for i, y in enumerate(p):
                want[at + i, y] += w / z
            for a, b in zip(p, p[1:]):
                both[a, b] += w / z
            begin[p[0]] += w / z
        at += n
    assert np.allclose(got, want, atol=1e-5) and np.allclose(pairs, both, atol=1e-4) and np.allclose(first, begin, atol=1e-5)
    assert np.allclose(langid.Lattice(lengths).marginals(e, t, s), want, atol=1e-5)


def test_long_texts_are_decoded_together_and_get_the_mean_of_their_words(monkeypatch):
    """The steps of long texts are shared by as many of them as fit, and results don't depend on how many do."""
    rng = np.random.default_rng(4)
    model = langid.Model(["a", "b", "c"], rng.normal(0, .3, (langid.BUCKETS, 3)).astype(np.float32), rng.normal(0, .5, (3, 3)), rng.normal(0, .5, 3))
    words = np.array([f"w{i}" for i in range(3000)] + ["1", "--"])
    texts = [" ".join(words[rng.integers(0, len(words), n)]) for n in [12_000] * 30 + [1, 7, 300]] + ["", None, " 12 -- "]
    made = []
    monkeypatch.setattr(langid, "Lattice", lambda n, real=langid.Lattice: made.append(len(n)) or real(n))
    best, score = model.label(pa.array(texts))
    assert made == [len(texts)]
    monkeypatch.setattr(langid, "DECODE_CELLS", 1, raising=False)
    few, few_score = model.label(pa.array(texts))
    assert len(made) > 2 and (best == few).all() and np.allclose(score, few_score, atol=1e-6)
    for i in (0, 29, 30, 31, 32):
        d = langid.Distinct(Words(pa.array([texts[i]]), lower=True))
        p = langid.Lattice(np.array([len(d.of)])).marginals(langid.factors(d.scores(model.weights))[d.of], np.exp(model.trans), np.exp(model.start))
        mean = p[d.letters[d.of]].mean(axis=0) if d.letters[d.of].any() else np.zeros(3)
        assert np.allclose(score[i], mean.max(), atol=1e-5) and best[i] == (mean.argmax() if mean.any() else -1)
    assert best[33:].tolist() == [-1, -1, -1] and score[33:].tolist() == [0, 0, 0]


def test_workers_keep_the_memory_of_arrays_between_blocks():
    """Arrays of up to a few megabytes are not mapped anew each time: every page of them would be a fault."""
    code = ("import resource as r, numpy as np\n"
            "def faults():\n"
            "    was = r.getrusage(r.RUSAGE_SELF).ru_minflt\n"
            "    for _ in range(200): np.arange(1 << 18).sum()\n"
            "    return r.getrusage(r.RUSAGE_SELF).ru_minflt - was\n"
            "faults(); print(faults())")
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | queries.WORKER_MEMORY, capture_output=True, text=True, check=True, timeout=120)
    assert int(done.stdout) < 20_000


def test_words_of_switching_texts_get_their_own_language(documents):
    model = langid.fit(documents)
    by = {x: [r.text for r in documents.where(F.col("lang") == x).limit(6).collect()] for x in ("en", "fr")}
    mixed = [" ".join(a.split()[:40] + b.split()[:40]) for a, b in zip(by["en"], by["fr"]) if len(a.split()) >= 40 <= len(b.split())]
    d = langid.Distinct(Words(pa.array(mixed), lower=True))
    p = langid.Lattice(np.full(len(mixed), 80)).marginals(langid.factors(d.scores(model.weights))[d.of], np.exp(model.trans), np.exp(model.start))
    best = np.array(model.labels)[p.argmax(axis=1)].reshape(len(mixed), 80)
    assert (best[:, :40] == "en").mean() > .9 and (best[:, 40:] == "fr").mean() > .9


def test_words_of_texts_in_two_languages_are_runs(llm, documents):
    model = langid.fit(documents)
    by = {x: [r.text.split() for r in documents.where((F.col("lang") == x) & (F.length("text") > 900)).orderBy("doc_id").limit(6).collect()] for x in ("de", "en")}
    mixed = [a[:60] + ["--", "12"] + b[:60] for a, b in zip(by["de"], by["en"])]
    df = llm.createDataFrame([(i, " ".join(x)) for i, x in enumerate(mixed)] + [(90, None), (91, " \n 12 !"), (92, "")], "doc_id long, text string")
    got = {r.doc_id: r.runs for r in df.select("doc_id", langid.word_languages(F.col("text"), model).alias("runs")).collect()}
    right = 0
    for i, x in enumerate(mixed):
        assert all(a.stop <= b.start and a.lang != b.lang for a, b in zip(got[i], got[i][1:])) and got[i][-1].stop == len(x)
        right += sum(("de" if k < 61 else "en") == r.lang for r in got[i] for k in range(r.start, r.stop)) / len(x)
    assert right / len(mixed) > 0.9 and got[90] == got[91] == got[92] == []


def test_a_language_of_long_texts_only_is_learned(llm, documents):
    """French comes in texts above the sample's length only, one of them very often."""
    french = [r.text for r in documents.where("lang = 'fr' and length(text) > 500").orderBy("doc_id").limit(24).collect()]
    english = [(r.doc_id, r.text, "en") for r in documents.where("lang = 'en' and length(text) > 200").orderBy("doc_id").limit(60).collect()]
    rows = english + [(10_000 + i, (t + " ") * (8001 // len(t) + 1), "fr") for i, t in enumerate(french)]
    rows += [rows[-1]] * 50 + [(20_000, t, "fr") for t in (rows[-2][1],)]
    df = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = langid.sample(df).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] <= 150 for r in chosen} == {"en": True, "fr": True}
    assert langid.sample(df, texts_per_lang=5).count() == 10 and langid.sample(df).agg(F.max(F.length("text"))).first()[0] <= 8000
    got = langid.identify(df).join(df.select("doc_id", "lang").distinct(), "doc_id")
    assert got.where("lang = 'fr' and lang_pred = 'fr'").count() > 0.9 * got.where("lang = 'fr'").count()


def test_language_of_odd_rows(odd_docs):
    got = langid.identify(odd_docs).collect()
    texts = [r.text for r in odd_docs.collect()]
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and (r.lang_pred != "und" or r.score == 0)
    assert langid.identify(empty(odd_docs)).count() == 0
    nothing = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}


# 6

def test_mixing_of_odd_rows(odd_docs, tmp_path):
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.mix_sources(odd_docs).select("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLE["op6_source_mixing"])
    columns = [d[0] for d in want.description]
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, want.fetchall())
    assert mixing.mix_sources(empty(odd_docs)).count() == 0


def test_targets_are_water_filling(llm):
    totals = llm.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 400), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(totals, (3, 1, 2), 1.5, 2).collect()}
    sizes, weights = {"a": 10, "b": 1000, "c": 5, "d": 0, None: 400}, {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    want, capped = {}, set()
    while True:  # clamp and redistribute until nothing is above
        left = 1.5 * 1415 - sum(2 * sizes[s] for s in capped)
        want = {s: 2 * sizes[s] if s in capped else left * w / sum(weights[x] for x in weights if x not in capped) for s, w in weights.items()}
        over = {s for s in want if s not in capped and want[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(want)


def test_the_mixture_holds_the_words_taken(documents):
    taken = mixing.mix_sources(documents).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"))
    mixed = mixing.repeated(documents)
    assert mixed.columns == documents.columns
    words = mixed.groupBy("source").agg(F.sum(mixing.words_of(F.col("text"))).alias("m"))
    rows = taken.join(words, "source").collect()
    assert len(rows) == 20 and all(r.n == r.m and 0 <= r.t - r.n < 1 for r in rows)
    assert mixing.repeated(documents).exceptAll(mixed).count() == 0


# 7

@pytest.mark.parametrize("size", [1, 2, 3, 64, 1000])
def test_feistel_is_a_permutation(size):
    a, b = (shards.permute(np.arange(size), size, k) for k in ("a", "b"))
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(size)) and (size < 10 or a.tolist() != b.tolist())


def test_shards_hold_every_sequence_at_its_slot(odd_docs, documents, vocabulary, encoding, tmp_path):
    docs = odd_docs.select("doc_id", "text").unionByName(documents.select("doc_id", "text")).coalesce(2)
    layout, path = shards.Layout(length=64, slots_per_shard=50), f"file://{tmp_path}/out"
    clashing = docs.withColumns({c: F.lit("x") for c in ("key", "slot", "shard", "part", "start", "body")})
    got = shards.write_shards(clashing, bpe.whole_texts(vocabulary), path, layout)
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".")]
    rows = got.collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n)) and all((r.shard, r.position) == layout.place(r.slot) for r in rows)
    back = list(shards.read_slots(path, layout, 0, n))
    assert [x.tolist() for x in shards.read_slots(path, layout, 49, 53)] == [x.tolist() for x in back[49:53]]
    ends = sum(bool(r.text) for r in docs.collect())
    tokens = sum(len(encoding.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sum(r.n_ids for r in rows) == tokens + ends
    flat = np.concatenate([back[s] for s in shards.permute(np.arange(n), n, "order")])
    parts = docs.select(F.spark_partition_id().alias("p"), "text").collect()
    want = []
    for p in sorted({r.p for r in parts}):
        ids = [i for r in parts if r.p == p and r.text for i in [*encoding.encode_ordinary(r.text), 50256]]
        want += ids + [50256] * (-len(ids) % 64)
    assert flat.tolist() == want
    sha = got.select("slot", F.sha2(shards.stored(F.col("slot"), path, layout), 256).alias("s")).collect()
    assert {r.slot: r.s for r in sha} == {i: brute.sha(x.tobytes()) for i, x in enumerate(back)}
    assert shards.write_shards(empty(docs), bpe.whole_texts(vocabulary), f"file://{tmp_path}/none", layout).count() == 0


# 8

def near_sets(n, seed):
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        base = [f"w{rng.integers(0, 400)}" for _ in range(rng.integers(1, 70))] if k % 4 == 0 else list(out[-1][1].split() if rng.random() < .5 else base)
        for _ in range(rng.integers(0, 3)):
            if base:
                i = rng.integers(0, len(base))
                base[i:i + 1] = [f"w{rng.integers(0, 400)}"] if rng.random() < .7 else []
        out.append((k, " ".join(base)))
    return out


@pytest.mark.parametrize("num,den,n", [(90, 100, 3), (80, 100, 1), (80, 100, 5), (50, 100, 2)])
def test_jaccard_join_is_brute_force(llm, num, den, n):
    rows = near_sets(160, num + n)
    got = jaccard.jaccard_groups(llm.createDataFrame(rows, "doc_id long, text string").repartition(3), num, den, n).collect()
    want = brute.components(rows, num, den, n)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) < 150
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(brute.shingles(t, n)) for i, t in rows}


def test_one_large_group_of_near_copies(llm, monkeypatch):
    rng = np.random.default_rng(8)
    base, rows, seen = [f"w{i}" for i in range(150)], [], []
    for k in range(400):
        words = list(base)
        for i in rng.choice(150, rng.integers(0, 8), replace=False):
            words[i] = f"x{rng.integers(0, 30)}" if rng.random() < .3 else f"y{k}-{i}"
        rows.append((k, " ".join(words)))
    real = jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda *a: seen.append(real(*a)) or seen[-1])
    got = jaccard.jaccard_groups(llm.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute.components(rows, 90, 100, 3)
    assert {r.doc_id: r.component_id for r in got} == want and 20 < len(set(want.values())) < 390
    assert seen


def test_comparisons_grow_with_a_group_not_with_its_square(llm, monkeypatch):
    """Near copies with changes of their own, some beyond a link with any other: what is compared is a few times the copies."""
    counted, real = [], jaccard._against
    monkeypatch.setattr(jaccard, "_against", lambda pairs, texts: counted.append(pairs.count()) or real(pairs, texts))
    per_copy = []
    for size in (500, 1000):
        rng, rows = np.random.default_rng(size), []
        for k in range(size):
            words = [f"w{i}" for i in range(150)]
            for i in rng.choice(150, rng.integers(0, 8), replace=False):
                words[i] = f"y{k}-{i}"
            rows.append((k, " ".join(words)))
        counted.clear()
        got = jaccard.jaccard_groups(llm.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        per_copy.append(sum(counted) / size)
        if size == 500:
            assert {r.doc_id: r.component_id for r in got} == brute.components(rows, 90, 100, 3)
    assert max(per_copy) < 8 and per_copy[1] < 1.3 * per_copy[0]


def test_sketches_fold_and_bound_the_difference(llm):
    rng = np.random.default_rng(2)
    rows, t = [], jaccard.Threshold(80, 100, 2)
    for k in range(60):
        base = [f"w{i}" for i in rng.integers(0, 10**6, rng.integers(1, 4000))]
        for other in (list(base), list(base)):
            for i in rng.integers(0, len(base), rng.integers(0, 1 + len(base) // 5)):
                other[i] = "x"
            rows.append((" ".join(base), " ".join(other[: len(other) - int(rng.integers(0, 1 + len(other) // 8))])))
    df = llm.createDataFrame(rows, "a string, b string")
    df = df.withColumn("x", jaccard._sketch(F.col("a"), t)).withColumn("y", jaccard._sketch(F.col("b"), t))
    for r in df.select("*", jaccard._bits_apart(F.col("x.bits"), F.col("y.bits")).alias("apart")).collect():
        x, y = brute.shingles(r.a, 2), brute.shingles(r.b, 2)
        assert r.x.n == len(x) and len(r.x.bits) * 64 >= 4 * t.differ(len(x))
        if min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
            assert r.apart <= len(x ^ y)


def test_jaccard_join_hands_texts_over_in_small_batches(llm, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, written = llm.conf.get(name), jaccard.written

    def noted(df):
        seen.append(llm.conf.get(name))
        return written(df)

    monkeypatch.setattr(jaccard, "written", noted)
    docs = llm.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "x y z")], "doc_id long, text string")
    assert {(r["node"], r["component"]) for r in jaccard.jaccard_components(docs, 90, 100, 3).collect()} == {(1, 1), (2, 1)}
    assert seen and set(seen) == {"1m"} and llm.conf.get(name) == before


def test_jaccard_join_of_odd_rows(odd_docs):
    got = jaccard.jaccard_groups(odd_docs).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute.components([r for r in rows if r[0] is not None], 90, 100, 3)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(
        (i, len(brute.shingles(t, 3)), want.get(i)) for i, t in rows)
    assert jaccard.jaccard_groups(empty(odd_docs)).count() == 0


def test_signatures_meet_wherever_sets_link():
    t = jaccard.Threshold()
    rng = np.random.default_rng(1)
    for size in (*range(1, 45), 120, 400):
        base = [f"a{i}" for i in rng.integers(0, 10**9, size + 2)]
        texts = [" ".join(base)]
        for k in range(4):
            other = list(base)
            for _ in range(k + 1):
                other[rng.integers(0, len(other))] = f"b{rng.integers(0, 10**9)}"
            texts.append(" ".join(other[k % 3:]))
        prints, row, sig = jaccard.signatures(pa.array(texts), t, jaccard.boundary(t))
        own = [{*sig[row == r].tolist(), int(prints[r])} for r in range(5)]
        sets = [brute.shingles(x, 3) for x in texts]
        for a in range(5):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    assert own[a] & own[b]


def test_components_of_long_paths_and_stars(llm):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(50)] + [(7, 7), (300, 299)]
    got = {r.node: r.component for r in components.components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in [*range(100, 150), 200]}, 299: 299, 300: 299}
    assert components.components(llm.createDataFrame([], "a long, b long")).count() == 0


# 9

def test_top_k_of_odd_vectors(llm):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None, 2.0, 3.0]), (1002, [float("nan")] * 4), (1003, [float("inf")] * 4), (None, [1.0] * 4), (1020, [2.0, 1.0]),
             (1040, [1.0, 1.0]), (1060, []), (1061, []), (1080, [3e15, 1.0, -2e15, 1.0]), (5, rows[5][1])]
    t = llm.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    v = t.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = topk.exact_top_k(v, v.where("vec_id % 20 = 0"), 7, shard_rows=40, block_queries=3).collect()
    fine = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want, limit = [], (1 << 63) - 1
    for q, a in fine:
        if q % 20 == 0:
            scored = sorted((-max(-limit, min(limit, sum(x * y for x, y in zip(a, b)))), i) for i, b in fine if i != q and len(b) == len(a))[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert topk.exact_top_k(empty(v), empty(v)).count() == 0


# 10

def test_quality_rules_are_brute_force(odd_docs, documents):
    rows = odd_docs.select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    rows = rows.where("doc_id is null or doc_id not in (10, 11)")
    got = quality.quality_rules(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = Counter((r.doc_id, *brute.quality(r.text, quality.Rules())) for r in rows.collect())
    assert Counter(map(tuple, got)) == want
    assert quality.quality_rules(empty(odd_docs)).count() == 0
    assert quality.quality_rules(odd_docs).count() == odd_docs.count()
