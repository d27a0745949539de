import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import lm
from scorelake.llm import sentencepiece as sp
from scorelake.llm.durable import table
from scorelake.llm.language import NgramModel, documents_model, html_language, html_text, language_id, letters, op9_language_id, sample_texts, thinned
from scorelake.llm.ngrams import subwords
from scorelake.llm.toxicity import BagModel, op5_toxicity, toxicity

SF = "/root/testdata/sf0.01"

# ---- SentencePiece ----------------------------------------------------------------------------

TEXTS = ["", None, " ", "  two  spaces ", "Hello world", "line\nfeed\r\n\ttab", "naïve café Ünïcode ß", "日本語 text 🙂🙂", "a\u2581b \u2581", "x" * 3000, "<s> </s> <0x41> <unk>", "\x00\x01", "!!!!!!!!!!!!!!!!!!!!", "supercalifragilisticexpialidocious " * 20]


@pytest.fixture(scope="module")
def pieces():
    with open(sp.MODEL, "rb") as f:
        return sp.Pieces(f.read())


def test_round_trip(spark, pieces):
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(TEXTS)], "doc_id long, text string, pieces string")
    got = sp.sentencepiece_decode(sp.sentencepiece_encode(df)).collect()
    assert {r["id"]: r["text"] for r in got} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert sp.sentencepiece_encode(df.limit(0)).count() == 0


def test_units_are_words_after_their_spaces_and_line_feeds():
    texts = ["a  b \n\n c", "", "x", " \n", "é\n d"]
    found, counts = sp.units([t.encode() for t in texts])
    cut = [[" a", "  b", " ", "\n", "\n", " c"], [], [" x"], ["  ", "\n"], [" é", "\n", " d"]]
    assert found.to_pylist() == sum(cut, []) and counts.tolist() == [len(c) for c in cut]


def test_ids_of_any_type_and_models_without_bytes(spark, pieces):
    df = spark.createDataFrame([("k", "né"), (None, None)], "doc_id string, text string")
    assert {(r["id"], r["text"]) for r in sp.sentencepiece_decode(sp.sentencepiece_encode(df)).collect()} == {("k", "né"), (None, "")}
    body = lambda p, kind: b"\x0a" + bytes([len(p) + 4]) + b"\x0a" + bytes([len(p)]) + p + b"\x18" + bytes([kind])
    bare = sp.Pieces(body(b"<unk>", 2) + body("▁".encode(), 1) + body(b"a", 1))
    ids, _ = sp.encode(bare, [b"az"], {})
    assert ids.tolist() == [1, 2, 0] and not bare.is_byte.any() and bare.decode(ids.tolist()) == "a ⁇ "


def brute_score(pieces, unit):
    known = {}
    for keys, ids, points in pieces.tables.values():
        for i, p in zip(ids, points):
            known["".join(map(chr, p))] = pieces.scores[i]
    text = unit.replace("\u2581", "\ue000").replace(" ", "\u2581")
    best = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - pieces.longest), j):
            s = known.get(text[i:j], pieces.unknown if j - i == 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_viterbi_matches_plain_dynamic_programming(pieces):
    units = [" Hello", " world", " naïve", "🙂🙂x", " supercalifragilistic", "     ", "   deep", " \u2581b", "z" * 40, "------------------"]
    known = {int(i) for _, ids, _ in pieces.tables.values() for i in ids}
    flat, sizes = pieces.encode_units(units)
    for unit, ids in zip(units, np.split(flat, np.cumsum(sizes)[:-1])):
        ids = ids.tolist()
        score, at = 0.0, 0
        while at < len(ids):
            if ids[at] in known:
                score, at = score + pieces.scores[ids[at]], at + 1
            else:  # one character's bytes
                first = pieces.bytes[ids[at]][0]
                at += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                score += pieces.unknown
        assert score == pytest.approx(brute_score(pieces, unit))


def test_same_as_the_library_under_its_unigram_algorithm(pieces):
    """The library, given the same pieces with the same scores and its model type set to unigram."""
    spm = pytest.importorskip("sentencepiece")

    def field(number, kind, payload):
        out, key = b"", number << 3 | kind
        for v in (key,) if kind == 5 else (key, len(payload)):
            while v > 127:
                out, v = out + bytes([v & 127 | 128]), v >> 7
            out += bytes([v])
        return out + payload

    with open(sp.MODEL, "rb") as f:
        data = f.read()
    out, i = b"", 0
    for number, value in sp._fields(data):
        if number == 1:
            got = dict(sp._fields(value))
            kind = got.get(3, 1)
            body = field(1, 2, got[1]) + field(2, 5, np.float32(pieces.scores[i]).tobytes()) + (bytes([3 << 3, kind]) if kind != 1 else b"")
            out, i = out + field(1, 2, body), i + 1
        elif number == 2:
            at, body = 0, b""
            while at < len(value):  # the model type is field 3, a number
                start = at
                key, at = sp._varint(value, at)
                if key & 7 == 0:
                    _, at = sp._varint(value, at)
                else:
                    size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else sp._varint(value, at)
                    at += size
                body += bytes([3 << 3, 1]) if key >> 3 == 3 else value[start:at]
            out += field(2, 2, body)
        else:
            out += field(number, 2, value)
    library = spm.SentencePieceProcessor(model_proto=out)
    texts = ["Hello world, this is an implementation.", "naïve café Ünïcode ß", "日本語 text 🙂", "Administration of characteristics", "The and attion to thanedble the, anea."]
    same = total = 0
    flat, sizes = sp.encode(pieces, [t.encode() for t in texts], {})
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        want = library.encode(text)
        assert pieces.decode(want) == text
        mine, theirs = (sum(pieces.scores[k] for k in x) for x in (ids.tolist(), want))
        assert mine == pytest.approx(theirs, abs=1e-3)
        same, total = same + (ids.tolist() == want), total + 1
    assert same >= total - 1  # equal scores may be cut differently


# ---- toxicity ---------------------------------------------------------------------------------


def test_subwords_match_plain_slicing():
    words = ["a", "idiot", "naïve", "🙂🙂", "ab", "a"]
    flat, sizes = subwords(words, 2, 3, 1 << 40)
    for w, n in zip(words, sizes):
        marked = f"<{w}>"
        assert n == sum(len(marked) - k + 1 for k in (2, 3)) + 1
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    assert parts[0].tolist() == parts[5].tolist() and len(set(parts[1].tolist()) & set(parts[2].tolist())) == 0


def test_held_out_toxicity(spark):
    got = {r["doc_id"]: r for r in op5_toxicity(spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) >= 0.93
    said, toxic = {i for i in held if got[i]["predicted"]}, {i for i in held if labels[i]}
    assert len(said & toxic) >= 0.6 * len(toxic) and len(said - toxic) <= 0.05 * len(said)  # six toxic documents are held out here


def test_scores_are_those_of_the_highest_window():
    """The forward pass in plain Python, one word and one window at a time."""
    rng = np.random.default_rng(3)
    model = BagModel(rng.normal(0, 5, 512).astype(np.float32), -1.5, 3, 6, 8)
    words = ["scum", "a", "the", "idiots", "naïve", "x" * 30]
    texts = ["", "scum", "  ", "the scum the scum", *[" ".join(rng.choice(words, n)) for n in (7, 8, 11, 12, 40, 101)]]
    for text, got in zip(texts, model.logits(texts, {})):
        some = text.split()
        windows = max(1, len(some) // 8 + (len(some) % 8 >= 4))
        sums = []
        for k in range(windows):
            mine = some[k * 8 : (k + 1) * 8 if k < windows - 1 else len(some)]
            means = [float(np.mean([float(model.weights[b]) for b in subwords([w], 3, 6, 512)[0]])) for w in sorted(set(mine))]
            sums.append(sum(means) / 8)
        assert got == pytest.approx(-1.5 + (max(sums) if some else 0.0), abs=1e-5)


def toxic_table(spark, n=300):
    rng = np.random.default_rng(0)
    fill = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("re", "su", "ta") for c in ("n", "do", "vi")]
    rows = []
    for i in range(n):
        words = rng.choice(fill, rng.integers(5, 300)).tolist()
        if i % 3 == 0:
            for _ in range(1 + len(words) // 60):
                words[rng.integers(len(words))] = str(rng.choice(["grobian", "scoundrel"]))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_misspellings_and_edges(spark):
    known = toxic_table(spark)
    asked = [(1000, "kare sudo you scoundrell miren loreta"), (1001, "kare sudo you miren loreta"), (1002, None), (1003, ""), (1004, "lovi " * 20_000 + "grobian " + "midon " * 20_000), (1005, "x" * 50_000), (1005, "x" * 50_000), (None, "grobian")]
    df = spark.createDataFrame([(i, t, 9.0, "s") for i, t in asked], "doc_id long, text string, score double, id string")
    got = toxicity(df, known.select("doc_id", "toxic"), learn="false")
    assert {r["score"] for r in got.collect()} == {0.5}  # nothing to learn from
    both = df.select("doc_id", "text").unionByName(known.select("doc_id", "text"))
    got = {}
    for r in toxicity(both, known.select("doc_id", "toxic")).collect():
        got.setdefault(r["id"], []).append(r["score"])
    assert got[1000][0] > 0.5 > got[1001][0] and got[1004][0] > 0.5 and got[None][0] > 0.5
    assert got[1002] == got[1003] and got[1002][0] < 0.5 and got[1005][0] == got[1005][1] < 0.5
    assert toxicity(df.limit(0), known.select("doc_id", "toxic")).count() == 0


# ---- language model ---------------------------------------------------------------------------


def brute_lm(rows):
    held = lambda i, n: zlib.crc32(("" if i is None else str(i)).encode()) % n
    texts = [(i, "".join(c.lower() if c.isascii() else c for c in t or "").encode().split() + [b"\n"]) for i, t in rows]
    one, two = Counter(), Counter()
    for i, t in texts:
        if held(i, 7) != 2:
            one.update(t)
            two.update(zip([b"\t"] + t, t))
    return texts, one, two, held


def score_rows(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    return lm.lm_score(df, learn="crc32(coalesce(cast(doc_id as string), '')) % 7 <> 2", estimation="crc32(coalesce(cast(doc_id as string), '')) % 7 = 3", **k)


def test_lm_counts_and_scores_match_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"W{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=np.arange(1, 41)[::-1] / 820))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "Élan É\x0bq"), (203, "w1 " * 30_000), (7, rows[7][1]), (None, "w1 w2")]
    texts, one, two, held = brute_lm(rows)
    n, v = sum(one.values()), len(one)
    one[b"\t"] = one[b"\n"]
    bucket = lambda c: 0 if c == 0 else min(int(math.log2(c)) + 1, lm.FREQUENCIES - 1)
    cells = []
    for i, t in texts:
        if held(i, 7) == 3:
            own, own2 = Counter(t), Counter(zip([b"\t"] + t, t))
            own[b"\t"] = 1
            for h, w in zip([b"\t"] + t, t):
                c = one[h] - own[h]
                cells.append((bucket(c), (two[h, w] - own2[h, w]) / max(1, c) * (v + 1), (one[w] - own[w]) / (n - len(t)) * (v + 1)))
    b = np.array([c[0] for c in cells])
    p = np.array([[c[1], c[2], 1.0] for c in cells])
    weights = np.tile([0.5, 0.4, 0.1], (lm.FREQUENCIES, 1))
    weights[0] = (0, 0.8, 0.2)
    for _ in range(60):
        m = p * weights[b]
        m /= m.sum(1, keepdims=True)
        s = np.stack([np.bincount(b, m[:, k], lm.FREQUENCIES) for k in range(3)], 1)
        full = s.sum(1) > 0
        weights[full] = s[full] / s[full].sum(1, keepdims=True)
        weights = np.maximum(weights, [0, 0, 1e-6])
        weights /= weights.sum(1, keepdims=True)
    want = sorted(
        (str(i), len(t), sum(one[w] > 0 for w in t), sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(weights[bucket(one[h])] @ (two[h, w] / max(1, one[h]), one[w] / n, 1 / (v + 1))) for h, w in zip([b"\t"] + t, t)))
        for i, t in texts
    )
    got = sorted((str(r["id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in score_rows(spark, rows, chunk_bytes=3000, part_bytes=2000).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3]) and g[4] == pytest.approx(w[4], rel=0.02)


def test_lm_edges(spark):
    assert score_rows(spark, []).count() == 0
    nothing = lm.lm_score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), learn="false", estimation="true").first()
    assert (nothing["train_tokens"], nothing["n_known"], nothing["score"], nothing["base_score"]) == (0, 0, 0.0, 0.0)


def test_keys_and_counts_pack_exactly():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5000):
        keys = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        assert (lm._keys_unpacked(lm._keys_packed(keys)) == keys).all()
        counts = rng.integers(0, 10**12, n)
        assert (lm._unpacked(lm._packed(counts)) == counts).all()


@pytest.mark.parametrize("ids, kind", [(["a", None, "b", "b"], "string"), ([(1, "x"), None, (2, None), (2, None)], "struct<n:int,s:string>")])
def test_scores_keep_ids_of_any_type(spark, ids, kind):
    df = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, ["a b a", "b", None, "a"], strict=True)], f"doc_id {kind}, text string, uid int")
    got = lm.lm_score(df, "true", "text = 'b'").collect()
    assert Counter((None if r["id"] is None else r["id"] if kind == "string" else tuple(r["id"]), r["n_tokens"]) for r in got) == Counter(zip(ids, [4, 2, 1, 2], strict=True))


# ---- language identification ------------------------------------------------------------------


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = documents_model(docs.filter("doc_id % 2 = 0"))
    got = language_id(docs.filter("doc_id % 2 = 1"), model, id_col="doc_id", host=F.col("source")).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([r["lang"] == truth[r["id"]] for r in got]) >= 0.99 and all(r["kept"] for r in got)


def test_evidence_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = documents_model(docs)
    french = docs.filter("lang = 'fr'").first()["text"]
    rows = [(i, french, "f.example.fr", "fr", "fr") for i in range(30)] + [(100, "x", "f.example.fr", "fr", "fr"), (101, None, None, None, None), (102, "", "", "", ""), (103, "123 !!", "f.example.fr", "fr", None), (104, french * 200, None, None, "de"), (104, french * 200, None, None, "de")]
    df = spark.createDataFrame([(*r, "zz") for r in rows], "id long, text string, host string, suffix string, declared string, lang string")
    got = {}
    for r in language_id(df, model, host=F.col("host"), suffix=F.col("suffix"), declared=F.col("declared")).collect():
        got.setdefault(r["id"], []).append(r)
    assert got[100][0]["lang"] == "fr" and got[100][0]["kept"]  # by its host, suffix and markup
    assert not any(got[i][0]["kept"] for i in (101, 102, 103)) and got[103][0]["lang"] == "fr"
    assert [r["lang"] for r in got[104]] == ["fr", "fr"]
    assert language_id(df.limit(0), model).count() == 0
    unlabelled = documents_model(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang"], r["kept"]) for r in language_id(df.filter("id in (100, 101)"), unlabelled).collect()} == {(None, True), (None, False)}


def test_any_count_of_rows_is_thinned(spark):
    """10^10 rows of a label: about one in 10^7 is drawn, and no product overflows."""
    got = spark.range(1_000_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h")).agg(
        F.count_if(thinned(F.col("h"), F.lit(10**10), 512)).alias("all"), F.count_if(thinned(F.col("h"), F.lit(10**6), 512)).alias("some"), F.count_if(thinned(F.col("h"), F.lit(700), 512)).alias("few")).first()
    assert got["all"] <= 3 and 850 < got["some"] < 1200 and got["few"] == 1_000_000


@pytest.mark.parametrize("same", [1, 7, 2**40])
def test_rows_that_share_an_id_are_drawn_each(spark, same):
    """20,000 rows of one id and text: 512 are taken, whichever id; a label all of whose rows share an id, and one of one row, are learnt."""
    rows = [(same, "the same words", "en", "s", 1)] * 20_000 + [(same, f"otros {i}", "es", "s", 1) for i in range(40)] + [(5, "seul", "fr", "s", 1), (None, "x", "de", "s", 1), (6, None, "de", "s", 1), (8, "x", None, "s", 1)]
    docs = table(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"))
    got = {r["y"]: r["count"] for r in sample_texts(docs, "doc_id", "text", "lang", 512, 9).groupBy("y").count().collect()}
    assert got == {"en": 512, "es": 40, "fr": 1}
    assert documents_model(docs).languages == ["en", "es", "fr"]


def test_counts_of_tasks_are_the_whole_texts_counts(spark):
    """Long texts teach whole: summed counts against one count of all texts."""
    texts = [("a", "uno dos tres " * 30_000), ("a", "quatro"), ("b", "one two 3 !!")]
    docs = table(spark.createDataFrame([(i, t, y) for i, (y, t) in enumerate(texts)], "doc_id long, text string, lang string").repartition(3))
    model = documents_model(docs, buckets=512)
    for i, y in enumerate(("a", "b")):
        want = np.full(512, 0.5)
        for own, t in texts:
            if own == y:
                want += np.bincount(subwords(letters(t), 1, 3, 512)[0], minlength=512)
        np.testing.assert_allclose(model.weights[:, i], np.log(want / want.sum()), rtol=1e-4)


def test_seventy_languages_and_long_texts_only(spark):
    words = lambda n: " ".join(chr(0x4E00 + 50 * n + k % 40) * 3 for k in range(300))
    rows = [(i, words(i % 70), f"l{i % 70:02}") for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = documents_model(docs, per_language=2)
    assert model.languages == [f"l{n:02}" for n in range(70)]
    assert {r["id"]: r["lang"] for r in language_id(docs, model, id_col="doc_id").collect()} == {i: y for i, _, y in rows}


def test_fusion_matches_plain_python(spark):
    """Posteriors by the formula of the docstring, over few rows."""
    model = NgramModel(["aa", "bb"], np.log(np.stack([np.linspace(1, 2, 4096), np.linspace(2, 1, 4096)], 1) / 6144))
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("abcdefgh "), 30)), ["x.com", "y.x.com", "z.org", None][i % 4], ["com", "org", None][i % 3], ["aa", None, "bb"][i * 7 % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, host string, suffix string, declared string")
    got = {r["id"]: r for r in language_id(df, model, host=F.col("host"), suffix=F.col("suffix"), declared=F.col("declared")).collect()}
    ll = [model.values(letters(t)).sum(0) for _, t, *_ in rows]
    best = [int(x.argmax()) for x in ll]
    count = lambda where: np.array([sum(b == k and where(r) for b, r in zip(best, rows)) for k in (0, 1)], dtype=float)
    smooth = lambda c, p: (c + 20 * p) / (c.sum() + 20)
    every = count(lambda r: True)
    prior = smooth(every, np.array([0.5, 0.5]))
    domain = lambda h: ".".join(h.split(".")[-2:])
    for i, (_, _, host, suffix, declared) in enumerate(rows):
        logs = 0.2 * ll[i]
        if host is None:
            logs = logs + np.log(prior)
        else:
            logs = logs + np.log(smooth(count(lambda r: r[2] == host), smooth(count(lambda r: r[2] is not None and domain(r[2]) == domain(host)), prior)))
        for at, value in ((3, suffix), (4, declared)):
            if value is not None:
                logs = logs + np.log((count(lambda r: r[at] == value) + 1) / (every + len({r[at] for r in rows if r[at]}) + 1))
        want = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert got[i]["posterior"] == pytest.approx(want.max()) and got[i]["lang"] == model.languages[int(want.argmax())]


def test_pages(spark):
    html = '<!DOCTYPE html><HTML class="a" lang=\'pt-BR\'><script>var t="</p>"</script><p>some <b>text</b></p>'
    r = spark.createDataFrame([(html,)], "h string").select(html_language(F.col("h")).alias("l"), html_text(F.col("h")).alias("t")).first()
    assert r["l"] == "pt" and r["t"].split() == ["some", "text"]
    got = op9_language_id(spark, "/root/testdata/sf0.001")
    pages = {r["page_id"]: r["url"].split("/")[3] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = [r for r in got.collect() if r["page_id"] is not None]
    assert np.mean([r["lang"] == pages[r["page_id"]] for r in rows]) > 0.9
