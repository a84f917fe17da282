"""Text operators against brute force, exact round trips, held-out accuracy and odd rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainweft.llm import decontaminate, langid, licences, mixing, neardup, quality, tokens, topk, toxicity, urls
from chainweft.llm.text import held_out, shingles, table, words

ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n", "en", None), (4, "one two", "en", "a"), (4, "one two", "en", "a"), (None, "no id here at all today", "fr", "b"), (5, "w" * 50_000, "de", "b"), (6, "a b c d e f " * 5_000, "en", "a")]


def shingle_set(text):
    w = words(text.encode()) if text else []
    return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def invented(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "ri", "tu", "me", "sa"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def components_by_force(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label, sets


def test_shingles_are_those_of_the_words():
    rng = random.Random(1)
    seen = {}
    for _ in range(300):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 9))]
        from chainweft.llm.text import WordHashes

        own = shingles(WordHashes().of(w))
        plain = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        assert len(own) == len(plain)
        for h, p in zip(own.tolist(), plain, strict=True):
            assert seen.setdefault(h, p) == p
    assert len(set(seen.values())) == len(seen)


def test_pigeonhole_keys_meet_every_pair_within_the_radius():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (400, neardup.COMPONENTS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(neardup.COMPONENTS, neardup.RADIUS, replace=False)
        row[at] ^= np.uint16(1)
    assert (neardup.keys(a) == neardup.keys(b)).any(axis=1).all()
    assert neardup.LOOSE * 2 + (neardup.CHUNKS - neardup.LOOSE) == neardup.RADIUS + 1


@pytest.mark.parametrize("group", [3, 60])
def test_near_duplicates_equal_brute_force(docs, group, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 8)
    rng = random.Random(group)
    rows = list(ODD)
    for g in range(6):
        base = invented(rng, 80).split()
        for k in range(group):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = invented(rng, 1)
            rows.append((1000 * (g + 1) + k, " ".join(text), "en", "a"))
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(rows)).collect() if r.doc_id is not None}
    want, sets = components_by_force([(r[0], r[1]) for r in rows])
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())


def test_deduplicated_keeps_columns_and_rows_without_id(docs):
    out = neardup.deduplicated(docs([*ODD, (9, "a b c d e f " * 5_000, "en", "a")]))
    assert out.columns == ["doc_id", "text", "lang", "source", "score"]
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[None] == 1 and ids[6] == 1 and ids[9] == 0 and ids[1] == 1


def test_decontamination_equals_brute_force(spark, docs):
    rng = random.Random(8)
    items = [(k, invented(rng, rng.randint(3, 70))) for k in range(25)] + [(98, None), (99, ""), (None, "no id"), (30, "one two")]
    rows = list(ODD)
    for k in range(120):
        body = invented(rng, rng.choice([5, 60, 900])).split()
        if k % 3 == 0:
            item = items[rng.randrange(25)][1].split()
            if k % 2:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = item
        rows.append((100 + k, " ".join(body), "en", "a"))
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, extra string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs(rows), bench).collect()}
    own = {i: shingle_set(t) for i, t in items if i is not None and shingle_set(t)}
    want = {(r[0], i) for r in rows for i, s in own.items() if len(s & shingle_set(r[1])) >= 0.8 * len(s)}
    assert got == want
    kept = decontaminate.decontaminated(docs(rows), bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in {d for d, _ in want})
    assert decontaminate.contaminations(docs(rows), bench.where("false")).count() == 0


def test_mix_meets_targets_and_reruns_agree(docs):
    rng = random.Random(9)
    rows = [(k, invented(rng, rng.choice([1, 5, 40, 300])), "en", rng.choice(["b", "a", "c", None, "zero"])) for k in range(400)]
    rows = [r if r[3] != "zero" else (r[0], None, "en", "zero") for r in rows]
    df = docs(rows)
    got = mixing.taken(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(df.repartition(7)).collect()))
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, full = 1.5 * sum(size.values()), {}
    while True:
        level = left / sum(weight[s] for s in names if s not in full)
        over = {s: 2.0 * size[s] for s in names if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
        left -= sum(over.values())
    source = {r[0]: r[3] for r in rows}
    took = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(full.get(s, level * weight[s]))
        assert 0 <= r.taken <= 2 * r.size
        took[s] += r.taken
    wide = {s: (took[s], full.get(s, level * weight[s])) for s in names}
    assert all(abs(a - b) <= 0.01 * size[s] + 5 for s, (a, b) in wide.items()), str(wide)
    out = mixing.repeated(df)
    assert out.columns == df.columns and out.count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.taken(df.where("false")).count() == 0 and mixing.taken(docs(ODD)).count() == len(ODD)


def test_rates_are_tilted_by_size(spark):
    sizes = spark.createDataFrame([("0a", 10, 50), ("0a", 20, 30), ("0a", 80, 5)], "skey string, size long, n long")
    aims = spark.createDataFrame([("0a", 1500, 1100.0)], "skey string, source_size long, target double")
    rows = {r.size: r.rate for r in mixing.rates(sizes, aims).collect()}
    assert sum(rows[s] * s * n for s, n in ((10, 50), (20, 30), (80, 5))) == pytest.approx(1100)
    assert np.log(rows[20]) / np.log(rows[10]) == pytest.approx(2) and np.log(rows[80]) / np.log(rows[10]) == pytest.approx(8)


def test_token_files_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(public_tokenizers.path(tokens.VOCABULARY)))
    rows = [*ODD, (7, "It's <|endoftext|> <|ENDOFTEXT|> Ça, é́. ΑΣ Σ. 12.5%… x\u00a0y\u2003z\x1cq don't, we'll. 日本語。", "fr", None), (-3, "tab\tand\u0301 İstanbul. ẞ.", "de", "z")]
    files = tokens.written(docs(rows))
    got = tokens.digests(files).collect()
    want, start = [], 0
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = tokens.digests(tokens.written(docs([])))
    assert empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and empty.count() == 0
    import pyarrow.parquet as pq

    column = pq.ParquetFile(sorted(files.inputFiles())[0].removeprefix("file://")).metadata.row_group(0)
    by = {column.column(k).path_in_schema: column.column(k) for k in range(column.num_columns)}
    assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and by["tokens.list.element"].has_dictionary_page
    assert all(c.has_column_index and c.has_offset_index for c in by.values())


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 64))
    data = [(k, [float(x) for x in base[k % 30] + rng.normal(size=64) * 0.3]) for k in range(300)]
    data += [(k, data[0][1]) for k in range(300, 360)]  # equal codes
    vectors = spark.createDataFrame([*data, (400, None), (None, data[1][1]), (401, [float("nan"), None, 1.0]), data[7]], "vec_id long, embedding array<double>")
    full = dict(data) | {401: [float("nan"), 0.0, 1.0]}
    code = {i: np.array([x > 0 for x in v] + [False] * (64 - len(v))) for i, v in full.items()}
    got = {}
    for r in topk.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbour_id))
    for q, found in got.items():
        want = sorted((int((code[q] != c).sum()), i) for i, c in code.items() if i != q)[:7]
        assert [(d, i) for _, d, i in sorted(found)] == want
    assert set(got) == {i for i in code if i % 50 == 0}
    assert topk.nearest(vectors.where("vec_id < 3"), vectors.where("vec_id = 0"), k=7).count() == 2
    assert topk.nearest(vectors.where("false"), vectors.where("false")).count() == 0


def test_url_rules_hosts_and_odd_urls(spark):
    rows = [
        (1, "http://a.COM/x", "a.com", "/x", "com/", "allow"), (2, "https://Example.com/en/1?q#z", "example.com", "/en/1", "example.com/en/", "block"),
        (3, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), (4, "http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
        (5, "http://com", "com", "", None, None), (6, "nothing", "", "", None, "allow"), (7, None, "", "", None, "allow"), (8, "http://xcom/", "xcom", "/", None, None),
        (9, "x://m.example.com/enx", "m.example.com", "/enx", "com/", "allow"), (10, "http://É.com/ÀB", "É.com", "/ÀB", "com/", "allow"), (10, "http://É.com/ÀB", "É.com", "/ÀB", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "h", "clash") for r in rows], "page_id long, url string, html string, rule string")
    got = urls.judged(pages, min_support=0.05).select("page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, host, path, rule, verdict in rows:
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule) and (verdict is None or by[i].verdict == verdict)
    assert urls.judged(pages.where("false")).count() == 0


def test_mined_rules_equal_counting(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        own = sorted({rng.choice("abcdef") for _ in range(4)})
        rows.append((own, "block" if "a" in own and "b" in own or rng.random() < 0.05 else "allow"))
    found = urls.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.02, min_confidence=0.9).collect()
    assert any(r.tokens == ["a", "b"] and r.verdict == "block" for r in found)
    for r in found:
        hit = [v for own, v in rows if set(r.tokens) <= set(own)]
        assert r.confidence == pytest.approx(sum(v == r.verdict for v in hit) / len(hit)) and r.confidence >= 0.9
        assert not any(set(o.tokens) < set(r.tokens) and o.verdict == r.verdict and o.confidence >= r.confidence for o in found)


def test_quality_learns_and_takes_odd_rows(spark, docs):
    rng = random.Random(7)
    rows = [(k, invented(rng, 60) if k % 3 else " ".join(w + "%%%" for w in invented(rng, 60).split()), "en", "a") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(400)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    df = docs(rows + [r for r in ODD if r[0] is None or r[0] > 400 or r[1] is None])
    weights = quality.train(df, labels)
    out = quality.scored(df, weights, "q").where("doc_id is not null").withColumn("h", held_out(F.col("doc_id"), 4, 2)).collect()
    tested = [r for r in out if r.h and r.doc_id != 1]
    assert len(tested) > 50 and np.mean([(r.q >= 0.7) == (r.doc_id % 3 > 0) for r in tested]) > 0.97
    assert all(0 <= r.q <= 1 for r in out)
    assert quality.passing(df, labels).columns == df.columns
    assert quality.passing(docs([]), labels.where("false")).count() == 0


def test_toxicity_restores_and_scores(spark, docs):
    rng = random.Random(11)
    bad = ["idiot", "moron", "scumbag"]
    rows = []
    for k in range(600):
        text = invented(rng, 50).split()
        if k % 5 == 0:
            text[rng.randrange(50)] = rng.choice(bad)
        rows.append((k, " ".join(text), "en", "a"))
    disguises = ["1d10t", "m.o.r.o.n", "id!ooooot", "i d i o t", "scumb@g", "5cumbag,"]
    rows += [(1000 + k, f"{invented(rng, 10)} {d} {invented(rng, 10)}", "en", "a") for k, d in enumerate(disguises)]
    rows += [(1100 + k, d, "en", "a") for k, d in enumerate(["555-1234 a@b 10.0.0.1", None, "", "x" * 30_000, "a1" * 5_000])]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    df = docs(rows)
    restored = toxicity.restoration(df)
    patterns, base = toxicity.train(df, labels, restored)
    out = {r.doc_id: r.score for r in toxicity.scored(df, restored, patterns, base, "score").collect()}
    assert all(out[1000 + k] >= 0.5 for k in range(len(disguises))), {d: out[1000 + k] for k, d in enumerate(disguises)}
    assert all((out[k] >= 0.5) == (k % 5 == 0) for k in range(600))
    assert all(out[1100 + k] < 0.5 for k in range(5))
    # repeated rows, clashing columns and an empty table
    odd = docs([*rows[:5], *rows[:5], *rows[-11:]]).withColumn("__key__", F.lit(1)).withColumn("score", F.lit("x"))
    again = toxicity.scored(odd, restored, patterns, base, "score")
    assert sorted(map(tuple, again.select("doc_id", "score").collect())) == sorted((r[0], out[r[0]]) for r in [*rows[:5], *rows[:5], *rows[-11:]])
    assert toxicity.scored(docs([]), toxicity.restoration(docs([])), patterns, base).count() == 0
    assert toxicity.train(docs([]), labels.where("false"), toxicity.restoration(docs([])))[0] == {}


def test_toxicity_model_and_scores_equal_brute_force(spark, docs):
    rng = random.Random(31)
    long_word = "".join(rng.choice("abcdefgh") + "i" for _ in range(60))
    texts = [f"{invented(rng, 20)} m0r{'o' * rng.randint(3, 5)}n! {long_word} k.o.r.i r i t u" for _ in range(40)] + [None, "", "漢字仮名" * 30]
    df = docs([(k, t, "en", "a") for k, t in enumerate(texts)])
    counts = Counter()
    for text in texts:
        for piece in (text or "").split():
            word = toxicity.plain(piece)
            if word.isalpha() and not toxicity._TRIPLE.search(word):
                framed = f" {word} "
                for end in range(1, len(framed)):
                    counts.update(framed[start : end + 1] for start in range(max(0, end - toxicity.ORDER), end + 1))
    model = toxicity.Model(counts.items())
    table = {r.gram: r for r in toxicity.language_model(df).collect()}
    assert {g: r.n for g, r in table.items() if r.n} == dict(counts)
    assert {g: (r.kinds, r.total) for g, r in table.items() if r.kinds} == model.after
    restored = toxicity.restoration(df)
    decoded = {r.spelling: set(r.words) for r in restored.words.collect()}
    assert decoded == {x: toxicity.words_behind(x, model) for x in decoded} and len(decoded) > 2
    patterns, base = {"moron$": 0.9, "kori": 0.3, "ritu$": 0.4, "bako": 0.2}, 0.01

    def by_force(text):
        pieces = (text or "").split()
        found = set()
        for piece in pieces:
            found |= toxicity.read_as_is(piece)
            for x in toxicity.spellings_of(piece):
                found |= toxicity.words_behind(x, model)
        for run in toxicity.runs(pieces):
            for x in toxicity.spellings_of_run(run):
                found |= toxicity.words_behind(x, model)
        return toxicity.chance(toxicity.patterns_of(found) & patterns.keys(), patterns, base)

    out = {r.doc_id: r.toxicity for r in toxicity.scored(df, restored, patterns, base).collect()}
    assert out == {k: pytest.approx(by_force(t)) for k, t in enumerate(texts)}


def test_disguised_pieces_are_decoded_exactly_and_whole():
    rng = random.Random(21)
    grams = Counter()
    for word in ["nice", "badword", "idiot", *(invented(rng, 1) for _ in range(30)), *("".join(rng.choice("ilgbaost") for _ in range(5)) for _ in range(60))]:
        text = f" {word} "
        for end in range(1, len(text)):
            grams.update({text[max(0, end - k) : end + 1]: 1 for k in range(min(end, toxicity.ORDER) + 1)})
    model = toxicity.Model(grams.items())

    def force(piece):
        """The least cost over every path."""
        paths = {(" ", "", ""): 0.0}
        for c in piece:
            ways = {}
            letters = [(c, 0.0)] if c.isalpha() else [(x, toxicity.SWAP) for x in toxicity.LOOK_ALIKE.get(c, "")]
            for (last, source, word), cost in paths.items():
                new = [((last + x)[-toxicity.ORDER :], c, word + x, cost + more + model.cost(last, x)) for x, more in letters]
                if source == c:
                    new.append((last, c, word, cost + toxicity.REPEAT))
                if not c.isalnum():
                    new.append((last, "", word, cost + (toxicity.DROP if c in toxicity.SEPARATORS else toxicity.KEEP)))
                    if c in toxicity.SEPARATORS and last != " ":
                        new.append((" ", "", word + " ", cost + toxicity.DROP + model.cost(last, " ")))
                elif not letters:
                    new.append((" ", "", word + c, cost + toxicity.KEEP))
                elif c.isdigit():
                    new.append((last, "", word, cost + toxicity.KEEP))
                for *state, total in new:
                    ways[tuple(state)] = min(total, ways.get(tuple(state), np.inf))
            paths = ways
        ends = {}
        for (last, _, word), cost in paths.items():
            ends[word] = min(cost + model.cost(last, " "), ends.get(word, np.inf))
        return {w for w, cost in ends.items() if cost <= min(ends.values()) + 1e-9}

    for _ in range(40):
        piece = "".join(rng.choice("1!|6046a.l") for _ in range(9))
        assert model.decode(piece) in force(piece), piece
    for piece in ("nice_b4dw0rd", "nice_" * 9 + "b4dw0rd"):
        assert any("badword" in toxicity.words_behind(x, model) for x in toxicity.spellings_of(piece))


def test_code_lengths_equal_plain_ppm():
    rng = random.Random(12)
    tree = Counter()
    for _ in range(200):
        text = b" " + invented(rng, 1).encode() + b" "
        for end in range(1, len(text)):
            for k in range(min(end, langid.ORDER) + 1):
                tree[text[end - k : end + 1]] += 1
    coder = langid.Coder([("x", dict(tree))])

    def bits(text):
        total = 0.0
        for end in range(1, len(text)):
            for k in range(min(end, langid.ORDER), -1, -1):
                context = text[end - k : end]
                after = {g[-1:]: n for g, n in tree.items() if g[:-1] == context}
                if not after:
                    continue
                whole = sum(after.values()) + len(after)
                if text[end : end + 1] in after:
                    total -= np.log2(after[text[end : end + 1]] / whole)
                    break
                total -= np.log2(len(after) / whole)
            else:
                total += 8
        return total

    for text in ["bako ritu xyz", "m", "é sa", "ba" * 3000]:
        assert coder.lengths(text)[0] == pytest.approx(sum(bits(b" " + w + b" ") for w in text.encode().split()))


def test_language_on_held_out_documents(spark, docs, sf):
    documents = table(spark, sf, "documents")
    trees = langid.train(documents)
    out = langid.identified(documents, trees).where(held_out(F.col("doc_id"), 5, 0)).collect()
    assert len(out) > 20 and np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    odd = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identified(docs([*ODD, (50, "123 %%", "en", "a")]), trees).collect()}
    assert odd[1] == odd[2] == odd[3] == odd[50] == ("und", 0.0) and odd[4][0] != "und"
    assert langid.train(docs([])) == [] and langid.identified(docs([(1, "abc", None, None)]), []).first().lang_pred == "und"


def test_language_trees_are_whole(spark, docs, monkeypatch):
    """Each count of each language is there, and joined windows cost what whole trees say."""
    monkeypatch.setattr(langid, "HOT_CELLS", 200)
    rows = [(k, f"{'fgh' * (k % 3)} qwz{k}", f"x{k:03}", "a") for k in range(530)]
    learn = docs(rows).where(~held_out(F.col("doc_id"), 5, 0)).collect()
    plain = {r.lang: Counter() for r in learn if r.lang}
    for r in learn:
        for word in (r.text or "").lower().encode().split() if r.lang else ():
            for window in langid._windows(word):
                plain[r.lang].update(window[k:] for k in range(len(window)))
    trees = langid.train(docs(rows))
    assert list(trees) == sorted(plain) and len(trees) > 410
    assert {(r.lang, bytes(r.gram)): r.n for r in trees.nodes.collect()} == {(lang, g): n for lang, tree in plain.items() for g, n in tree.items()}
    coder = langid.Coder([(lang, plain[lang]) for lang in trees])
    some = docs([*rows[:3], (None, "qwz9 fghfgh vvv qwz9", None, "a"), (4, None, None, "a")])
    for r in langid.identified(some, trees).collect():
        pred, score = coder.predict(r.text)
        assert r.lang_pred == pred and r.lang_score == pytest.approx(score)


def test_licences_are_inherited_from_the_nearest_folder(spark):
    rows = [
        (1, "a/LICENSE", "MIT License\n\nThe MIT License (MIT)"), (2, "a/b/x.py", "code"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/y.py", "other things\nThis work is licensed under the GNU General Public License, version 3.\nmore"), (5, "a/b/c/z.py", None), (6, "q.py", ""), (7, None, "plain"), (8, "ab/x.py", "mit."), (8, "ab/x.py", "mit."),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, licence string")
    got = sorted(((r.doc_id, r.licence, r.origin, r.from_folder) for r in licences.scanned(files).collect()), key=str)
    assert got == sorted([
        (1, "MIT", "own", None), (2, "Apache-2.0", "inherited", "a/b"), (3, "Apache-2.0", "own", None), (4, "GPL-3.0", "own", None),
        (5, "Apache-2.0", "inherited", "a/b"), (6, None, "none", None), (7, None, "none", None), (8, None, "none", None), (8, None, "none", None),
    ], key=str)
    assert licences.scanned(files.where("false")).count() == 0


def test_licences_are_found_anywhere_in_a_text(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    code = [f"var x{k}=f{k}(y{k})" for k in range(1500)]
    texts = [
        f"{';'.join(code)}; /* {notice} */ {';'.join(code)}", f"{notice} import os; run{{}} {' '.join(code[:30])}",
        "\n".join(code[:200]) + "\n# Licensed under the Apache\n# License, Version 2.0.\n" + "\n".join(code[:200]), ";".join(code),
    ]
    files = spark.createDataFrame([(k, f"s/{k}.js", t) for k, t in enumerate(texts)], "doc_id long, path string, text string")
    assert {r.doc_id: r.licence for r in licences.scanned(files).collect()} == {0: "Apache-2.0", 1: "Apache-2.0", 2: "Apache-2.0", 3: None}


def test_outlines_cover_whole_words():
    plain = b"a" * 80
    assert quality._shape(plain) == b"a" and quality._shape(plain + b"<B9>") == b"a<A9>"
    assert not np.array_equal(quality.features(plain + b"%%%" + b"9" * 9)[0][2:], quality.features(plain + b"9" * 9)[0][2:])


def test_pipeline_stages_feed_each_other(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, stage(spark, docs, sf)
        assert docs.columns == before, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= 2 * total
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).orderBy("start").collect()
    assert len(rows) == docs.count() and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_pipeline_takes_odd_rows_and_empty_tables(spark, sf, tmp_path):
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(f"{tmp_path}/{name}.parquet")
        table(spark, sf, name).where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    plain = table(spark, sf, "documents").withColumns({"score": F.lit("x"), "size": F.lit(1), "__mark__": F.lit("y")})
    first = plain.orderBy("doc_id").limit(1)
    nothing = first.withColumns({c: F.lit(None).cast(t) for c, t in first.dtypes})
    blank = first.withColumn("doc_id", F.lit(10**9) + F.col("doc_id")).withColumn("text", F.lit(" \n"))
    giant = first.withColumn("doc_id", F.lit(2 * 10**9) + F.col("doc_id")).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 200))
    plain.unionByName(plain).unionByName(nothing).unionByName(blank).unionByName(giant).write.parquet(f"{tmp_path}/documents.parquet")
    plain.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert rows and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert None not in {r.doc_id for r in rows} and 10**9 not in {r.doc_id // 10**9 * 10**9 for r in rows}
    kept = plain.select("doc_id").distinct().collect()
    assert {r.doc_id for r in rows if r.doc_id < 10**9} <= {r.doc_id for r in kept}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_quality_sample_takes_one_row_of_an_id(spark, docs):
    rows = [(k, "fine words stand here in rows" if k % 2 else "%%% $$$ 111 ~~~", "en", "a") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    once = quality.train(docs(rows), labels)
    again = quality.train(docs([*rows, *rows[:30], *((k, t + " zz", lang, s) for k, t, lang, s in rows[30:])]), labels)
    assert once.any() and np.array_equal(once, again)


def test_rows_that_share_an_id_are_one_document_for_benchmarks(spark, docs):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    bench = spark.createDataFrame([(1, item), (2, item[::-1])], "item_id long, text string")
    rows = [(7, f"a b {item} c", "en", "a"), (7, f"d e {item[::-1]} f", "en", "a"), (8, item, "en", "a")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs(rows), bench).collect()}
    assert found == {(7, 1), (7, 2), (8, 1)}


def test_mixing_rounds_until_nothing_moves_and_says_when_unsolved(spark, docs, monkeypatch):
    rng = random.Random(17)
    rows = [(k, "w " * rng.choice([1, 2, 3, 5, 17, 40, 301]), "en", rng.choice("abcd")) for k in range(300)]
    found = mixing.taken(docs(rows)).withColumn("source", F.col("source_size")).collect()
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        over = sum(r.taken for r in own) - round(own[0].target)
        assert not any(0 < r.size <= abs(over) and (r.taken > 0 if over > 0 else r.taken < 2 * r.size) for r in own if over), (source, over)
    monkeypatch.setattr(mixing, "STEPS", 0)
    with pytest.raises(RuntimeError):
        mixing.taken(docs(rows))


def test_check_sql_agrees(spark, sf):
    import compare
    from chainweft.llm import queries

    db = compare.database(sf)
    for name, sql in queries.CHECKS.items():
        ok, note = compare.compare(spark, db, sf, name, queries.QUERIES[name], sql)
        assert ok, (name, note)


def test_token_pieces_equal_whole_texts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from chainweft.llm import tokens

    path = str(public_tokenizers.path(tokens.VOCABULARY))
    plain, draw = Tokenizer.from_file(path), random.Random(3)
    # letters that are read as a letter and a mark, endings after an apostrophe, special tokens, marks, other spaces
    parts = ["a", "B", "e\u0301", "\u0130", "\u0958", "\u212b", "'", "'s", "'LL", "<|", "<|endoftext|>", "<|startoftext|>", ".", "###", "-",
             "7", " ", "\t", "\x85", "\xa0", "\u0338", "<", "\u01c5", "\ud55c", "\x00", "</w>", "Abc.", "b" * 60]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(3000)]
    letters = [chr(c) for c in range(0x3000) if chr(c).isalpha()]
    texts += [c + sign for c in letters for sign in ("", ".", "'s")]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # new pieces, then known ones
        got = tokens.encode([t.encode() for t in texts], path, None)
        assert [g.tolist() for g in got] == want


def test_topk_grows_radii_to_coverage(spark, monkeypatch):
    """Fifty thousand random codes: no query is covered before radius 3, and every radius is met."""
    from pyspark.sql import functions as F

    n = 50_000
    codes = np.random.default_rng(9).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(10).integers(0, 2, n, dtype=np.uint64)
    codes[1:4] = codes[0] ^ np.array([1, 3, 1 << 40], np.uint64)
    rows = spark.createDataFrame(zip(range(n), codes.view(np.int64).tolist(), strict=True), "vec_id long, code long")
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.call_function("shiftrightunsigned", F.col("code"), i).bitwiseAND(F.lit(1).cast("long")) == 1, 1.0).otherwise(-1.0))
    vectors = rows.select("vec_id", bits.alias("embedding"))
    radii, looked_up = [], topk._looked_up

    def noted(*given):
        radii.append(given[2])
        return looked_up(*given)

    monkeypatch.setattr(topk, "_looked_up", noted)
    asked = [0, 7, 25_000, 49_999]
    got = {}
    for r in topk.nearest(vectors, vectors.where(F.col("vec_id").isin(asked)), k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbour_id))
    for q in asked:
        distance = np.bitwise_count(codes ^ codes[q]).astype(int)
        want = sorted((int(d), i) for i, d in enumerate(distance) if i != q)[:10]
        assert [(d, i) for _, d, i in sorted(got[q])] == want
    assert max(radii) >= 3 and set(range(max(radii) + 1)) == set(radii)


def test_shingles_mix_all_places_in_one_call(monkeypatch):
    """Two calls a text, whatever the width; the values are those of the plain rule."""
    from chainweft.llm import text

    rng = np.random.default_rng(3)
    calls = []
    kept = text.mixed
    monkeypatch.setattr(text, "mixed", lambda values: calls.append(1) or kept(values))
    mask = (1 << 64) - 1

    def plain(x: int) -> int:
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    for n, width in ((1, 5), (4, 5), (5, 5), (40, 5), (9, 7)):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        span = min(n, width)
        want = [
            plain((span + sum(plain((int(hashes[i + k]) + k + 1) & mask) * int(text._ODD[k % 5]) for k in range(span))) & mask)
            for i in range(n - span + 1)
        ]
        calls.clear()
        assert [int(v) for v in text.shingles(hashes, width)] == want and len(calls) == 2


def test_toxicity_keeps_one_row_for_copies_of_a_text(spark, docs):
    """Joins on a text's key must not multiply copies by copies."""
    df = docs([(k, "you b4dword h3re", "en", "a") for k in range(40)] + [(40 + k, f"b.a.d.w.o.r.d of {k}", "en", "a") for k in range(5)] + [(50, "plain text", "en", "a"), (51, None, "en", "a")])
    restored = toxicity.restoration(df)
    assert restored.spelt.count() == 6
    assert {x for r in restored.spelt.collect() for x in r.spellings} == {"b4dword", "h3re", "b.a.d.w.o.r.d"}
    assert toxicity.scored(df, restored, {"badword$": 0.9}, 0.1).count() == 47


def test_window_search_folds_blocks_and_mixes_nothing_a_window(monkeypatch):
    """Windows' keys are those of plain minima; only shingles are mixed, two calls a text."""
    from types import SimpleNamespace

    import pyarrow as pa

    from chainweft.llm import text

    calls = []
    kept = text.mixed
    for module in (text, decontaminate):
        monkeypatch.setattr(module, "mixed", lambda values: calls.append(1) or kept(values))
    every = SimpleNamespace(value=np.full(decontaminate.BITS // 8, 255, np.uint8))
    for n in (1, 15, 16, 17, 64, 100, 300):
        words = " ".join(f"w{k}" for k in range(n + 4))
        runs = decontaminate._runs(words.encode())
        want = set()
        for upper in (16, 64):
            starts = range(0, max(1, -(-n // upper) - 1) * upper, upper)
            for at in starts:
                least = np.array([(runs[at : at + 2 * upper] * a).min() for a in decontaminate._A], np.uint64)
                want |= set(decontaminate._keys(least, upper).view(np.int64).tolist())
        batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([1], pa.int64()), pa.array([words.encode()], pa.binary())], ["ident", "doc_id", "text"])
        calls.clear()
        (out,) = decontaminate._searched(every, every, [16, 64])(iter([batch]))
        assert set(out.column("keys").to_pylist()[0]) == want and len(calls) == 2
