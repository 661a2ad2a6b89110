"""The training-data operators against brute force, on odd rows and on the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from ledgerline.llm import (
    bpe,
    chat,
    extraction,
    fingerprints,
    line_dedup,
    links,
    minhash,
    mixing,
    quality_model,
    quality_rules,
    ranges,
    sharding,
)
from ledgerline.llm.common import ship
from ledgerline.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, label int, words int"
LONG = " ".join(f"w{i}" for i in range(12_000))
COPIED = "one two three four five six seven eight nine ten eleven twelve " * 3
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one two", "en", "b"), (None, "no id here\nat all", "en", "b"),
    (5, COPIED, "en", "a"), (6, COPIED, "en", "a"), (7, COPIED.upper(), "en", None), (8, LONG, "en", "c"), (8, LONG, "en", "c"),
    (9, "A shared line here\nown line nine\n\nA shared line here", "en", "c"), (10, " a SHARED line here \nend<|endoftext|>é", "fr", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", "y", 1, 2) for i, t, la, s in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 1, 0), (8, 0, 0), (9, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = words(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_empty_tables_give_no_rows(spark, empty, labels):
    for found in (
        mixing.mix(empty), mixing.mixed_documents(empty), sharding.sharded(empty), minhash.near_duplicates(empty),
        minhash.without_near_duplicates(empty), quality_model.scored(empty, labels), quality_rules.digest(empty, labels),
        quality_rules.good_documents(empty, labels), fingerprints.compared(empty), line_dedup.digest(empty),
        line_dedup.with_lines_dropped(empty), bpe.digest(empty, tokenizer_path()),
        extraction.extracted(spark.createDataFrame([], "page_id long, url string, html string")),
        chat.formatted(spark.createDataFrame([], "conv_id long, turn int, role string, text string")),
    ):
        assert found.count() == 0


def test_mix(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert sum(r.size for r in rows) == sum(len(words(t)) for _, t, _, _ in ODD)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
    targets = {r.source: r.target for r in rows}
    assert round(sum(targets.values())) == round(1.5 * sum(r.size for r in rows))
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_shards_are_near_equal_and_slots_gapless(spark):
    documents = spark.read.parquet(str(TESTDATA / "sf0.001/documents.parquet"))
    rows = sharding.sharded(documents).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    largest = max(r.size for r in rows)  # a record is never cut in two
    assert set(sizes) == set(range(8)) and all(abs(size - sum(sizes.values()) / 8) <= largest for size in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(odd):
    rows = sharding.sharded(odd).collect()
    assert len(rows) == len(ODD) and {r.size for r in rows if r.doc_id in (1, 2)} == {1}


def test_near_duplicates_equal_brute_force(odd):
    found = {r.doc_id: r for r in minhash.near_duplicates(odd).collect()}
    assert {i: r.component_id for i, r in found.items()} == {
        None: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10}
    assert all(found[i].n_shingles == len(shingles(t)) for i, t, _, _ in ODD)
    kept = minhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 10]


def test_components_of_a_long_chain(spark, odd):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 100)], "a long, b long")
    assert {r.node: r.component for r in links.components(edges).collect()} == dict.fromkeys(range(61), 0) | {100: 100, 101: 100}


def test_a_family_that_its_first_member_does_not_hold_together(spark):
    base = [f"b{i}" for i in range(300)]
    texts = {0: " ".join(base[:100] + [f"x{i}" for i in range(200)])}
    for i in range(1, 60):
        own = list(base)
        for k in range(i % 6):
            own[(i * 37 + k * 53) % 300] = f"n{i}-{k}"
        texts[i] = " ".join(own)
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents).collect()} == label
    assert {r.doc_id: r.component_id for r in fingerprints.similar(documents, 85).collect()}.items() <= label.items()


def test_classifier_holds_up_on_held_out_rows(spark, odd, labels):
    known = spark.read.parquet(str(TESTDATA / "sf0.01/labels.parquet"))
    scored = quality_model.scored(spark.read.parquet(str(TESTDATA / "sf0.01/documents.parquet")), known)
    rows = scored.filter("held_out").join(known, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows) and len(rows) > 50
    assert all(0 <= r.score <= 1 for r in quality_model.scored(odd, labels).collect())


def test_quality_counts_equal_brute_force(odd, labels):
    found = {r.doc_id: r for r in quality_rules.digest(odd, labels).collect()}
    for i, text, _, _ in ODD:
        w, r = words(text), found[i]
        runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.good_documents(odd, labels).columns == odd.columns


def test_junk_is_rejected_and_clean_text_kept(spark):
    sf = TESTDATA / "sf0.01"
    known = spark.read.parquet(str(sf / "labels.parquet"))
    rows = quality_rules.digest(spark.read.parquet(str(sf / "documents.parquet")), known).join(known, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.3 * sum(r.quality == 0 for r in rows)


PAGE = (
    "<html><head><title>t</title></head><body><nav><a href=/>menu</a></nav><div class=box>Every page says this</div>"
    "<article><h1>Title %d &amp; more</h1><p>One<b>two</b>\n three <br>four<p>quoted everywhere</article>"
    "<div id='comments'>first!</div><footer>end</footer></body></html>")


def test_pages(spark, odd):
    rows = [(i, "https://Host.example/p", PAGE % i) for i in range(8)] + [
        (20, None, None), (21, "not a url", "<p>a<p>b<!-- c"), (22, "http://x.y/", '<a "' * 50 + "<script>if (a</b>) '<p>'"),
        (None, "http://x.y/", "<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>")]
    rows += [(30 + i, "https://other.example/", f"<body><div><span>Told on all pages</span></div><p>own {i}</p></body>") for i in range(6)]
    found = {r.page_id: r for r in extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3].text == "Title 3 & more\nOnetwo three four\nquoted everywhere" and found[3].n_chars == len(found[3].text)
    assert found[20].text == "" and found[21].text == "a\nb" and found[22].n_chars == len(found[22].text) and found[None].text == "x\ny\n1 2"
    assert [found[30 + i].text for i in range(6)] == [f"own {i}" for i in range(6)]


def test_pages_of_several_main_parts_and_blocks_on_few_pages_of_a_large_host(spark):
    parts = ("<body><div>skip<nav>menu</nav></div><main><p>lead</p><article><p>one</p></article><p>after</p></main>"
             "<div role=main><p>second</p></div><article><p>apart</p></article></body>")
    assert extraction.main_text(extraction.parse(parts)) == "lead\none\nafter\nsecond\napart"
    apart = "<body><p>out</p><div><article><p>one</p></article><p>between</p><nav>x</nav><article><p>two</p></article></div></body>"
    assert extraction.main_text(extraction.parse(apart)) == "one\nbetween\ntwo"
    rows = [(i, "https://large.example/", ("<div>Told on some pages</div>" if i < 6 else "") + f"<p>own {i}</p>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in extraction.extracted(pages).collect()} == {f"own {i}" for i in range(300)}


def test_fingerprints_of_edited_texts(odd):
    found = {r.doc_id: r for r in fingerprints.compared(odd.dropDuplicates(["doc_id"])).collect()}
    order = [(i, t or "") for i, t in sorted({i: t for i, t, _, _ in ODD}.items(), key=lambda x: (x[0] is None, x[0] or 0))]
    for k, (i, text) in enumerate(order):
        after, quarter = order[(k + 1) % len(order)][1], len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert found[i].n_chars == len(text) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert found[5].fingerprint == found[6].fingerprint != found[8].fingerprint
    assert found[5].near_next == 1.0 and found[8].near_next < 0.2


def test_fingerprints_of_unrelated_very_long_texts_differ():
    for length in (20_000, 150_000, 400_000):
        a, b = fingerprints.signatures(pa.array([" ".join(f"{name}{i}" for i in range(length)) for name in "ab"]))
        assert fingerprints.likeness(a, b) < 0.05


def test_similar_documents_equal_brute_force(spark, odd):
    base = [f"Word{i}" for i in range(200)]
    rows = [(i, t) for i, t, _, _ in ODD] + [
        (20, " ".join(base)), (21, " ".join(base).upper()), (22, " ".join(base)), (23, " ".join([*base[:190], "x", "y"])),
        (24, " ".join(base[:100])), (30, "short"), (31, "SHORT"), (40, " ".join(f"a{i}" for i in range(150_000))),
        (41, " ".join(f"b{i}" for i in range(150_000)))]
    sets = [shingles(t) for _, t in rows]
    label = [i for i, _ in rows]
    for _ in range(3):
        for j, a in enumerate(sets):
            for k, b in enumerate(sets):
                if None not in (label[j], label[k]) and a and 100 * len(a & b) >= 80 * len(a | b):
                    label[j] = label[k] = min(label[j], label[k])
    found = fingerprints.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr((i, c)) for (i, _), c in zip(rows, label, strict=True))


def test_similar_documents_are_a_query_over_the_whole_table(spark):
    sf = str(TESTDATA / "sf0.001")
    found = QUERIES["op8_similar_documents"](spark, sf).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in found) == sorted(ids)
    assert all(r.component_id <= r.doc_id for r in found)


def test_line_dedup(odd):
    found = {r.doc_id: r for r in line_dedup.digest(odd).collect()}
    keep = hashlib.sha256(b"end<|endoftext|>\xc3\xa9").hexdigest()
    assert (found[10].n_lines, found[10].n_dropped, found[10].kept_sha256) == (2, 1, keep)
    assert (found[9].n_lines, found[9].n_dropped, found[1].n_lines, found[6].n_dropped) == (4, 0, 1, 1)
    changed = {r.doc_id: r for r in line_dedup.with_lines_dropped(odd).collect()}
    assert changed[10].text == "end<|endoftext|>é" and changed[10].n_chars == 17 and changed[1].text is None


def test_encoding_equals_the_library_and_decodes_to_the_text(odd):
    from tokenizers import Tokenizer

    library, path = Tokenizer.from_file(tokenizer_path()), tokenizer_path()
    texts = {i: t or "" for i, t, _, _ in ODD}
    for r in bpe.digest(odd, path).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(odd.dropDuplicates(["doc_id"]), path), path)
    assert {r.doc_id: r.text for r in back.collect()} == texts
    own = bpe.tokenizer(path)
    for text in ("a" * 500, "\x00\x1c\x85　x  y ", "naïve ﷺ 𝟘١", "it's WE'LL 12ab", " \n\n "):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_conversations_in_blocks_and_odd_rows(spark, odd, monkeypatch):
    rows = [(1, t, "user" if t % 2 else "assistant", f"line {t}?\n" * (t % 3 + 1)) for t in range(40)]
    rows += [(2, 0, None, None), (2, 0, None, None), (None, None, "user", "hm"), (3, 1, "strange", "Human: yes"), (3, 2, "user", "")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pick = lambda: sorted(map(repr, chat.formatted(talks).select("conv_id", "turn", "states", "rendered").collect()))
    whole = pick()
    monkeypatch.setattr(ranges, "LEAST_ROWS", 3)
    assert pick() == whole and len(whole) == len(rows)
    assert chat.marker_of("### Assistant: yes") == ("assistant", "yes") and chat.marker_of("users: x")[0] is None


def test_pipeline_drops_near_duplicates_from_080(spark):
    import corpus_pipeline

    base = [f"b{i}" for i in range(200)]
    near = ["x" if i in (40, 80, 120, 160) else w for i, w in enumerate(base)]
    a, b = shingles(" ".join(base)), shingles(" ".join(near))
    assert 0.80 < len(a & b) / len(a | b) < 0.85
    documents = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents, "").collect()] == [1]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    sf = str(TESTDATA / "sf0.001")
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, documents, sf)
    kept = {r.doc_id: r.text for r in good.collect()}
    first = {}
    for i in sorted(kept):
        for line in (kept[i] or "").split("\n"):
            first.setdefault(low(line.strip(" \t\n\x0b\x0c\r")), i)
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    want = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in kept.items()}
    lines = corpus_pipeline.drop_shared_lines(spark, good, sf)
    assert {r.doc_id: r.text for r in lines.collect()} == want and lines.columns == documents.columns
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "BPE"


def test_signature_bytes_of_unrelated_long_texts_differ(spark):
    ship(spark)
    for n in (100, 1000, 5000):
        rows = [(k, " ".join(f"{k}x{i}" for i in range(n + 4))) for k in range(6)]
        sketch = minhash.sketched(spark.createDataFrame(rows, "doc_id long, text string"), minhash.circulant_signatures, 32, 6)
        sigs = [r.sig for r in sketch.collect()]
        agree = [sum(x == y for x, y in zip(a, b, strict=True)) / len(a) for i, a in enumerate(sigs) for b in sigs[:i]]
        assert sum(agree) / len(agree) < 0.05


def test_fingerprints_where_all_ids_are_null(spark):
    texts = ["b " * 20, "a c " * 10, None]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    order = sorted(t or "" for t in texts)
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 4] + order[(k + 1) % 3][: len(t) // 4]).encode()).hexdigest()
                   for k, t in enumerate(order))
    assert Counter(r.edited_sha256 for r in fingerprints.compared(df).collect()) == want


def test_folders_are_shared_or_it_is_an_error():
    from types import SimpleNamespace

    from ledgerline.llm.common import shared_folder

    def session(master, named):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("spark://x:7077", "hdfs://store/tmp/")) == "hdfs://store/tmp"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://x:7077", None))
    assert shared_folder(session("local[2]", None)).startswith("/")
