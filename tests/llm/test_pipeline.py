"""The pipeline's stages: their order, columns, and decisions."""

import corpus_pipeline as P
from tidemark.llm.common import stage


def test_stages_on_the_standard_tables(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), [200]
    for name, function in P.STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        if name != "packing":
            assert docs.columns == P.COLUMNS
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] > seen[3] == seen[4]


def test_decisions(spark, sf_dir, tmp_path):
    en, de = "the house and the garden with some water for the people of the town ", "das haus und der garten mit etwas wasser fuer die leute aus der stadt "
    text = lambda i, base: " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for w in base.split()) + " " + base
    rows = [(i, text(i, en if i % 2 else de), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    rows += [(100, "12345 67890", "en", "s", 0), (101, None, "en", "s", 0), (102, text(3, en), "en", "s", 0), (102, text(3, en), "en", "s", 0), (500, "unique words here mail bob@example.org now " + text(90, en), "en", "s", 0), (500, "unique words here mail bob@example.org now " + text(90, en), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = stage(P.language(spark, docs, sf_dir), "a")
    assert {100, 101} & {r.doc_id for r in kept.select("doc_id").collect()} == set() and kept.count() == 64
    kept = stage(P.near_duplicates(spark, kept, sf_dir), "b")
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert 102 not in ids and ids.count(500) == 1
    item = rows[5][1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    kept = stage(P.decontaminate(spark, kept, f"file://{tmp_path}"), "c")
    assert 5 not in {r.doc_id for r in kept.select("doc_id").collect()}
    masked = {r.doc_id: r for r in P.personal_data(spark, kept, sf_dir).collect()}
    assert "mail <EMAIL> now" in masked[500].text and masked[500].n_chars == len(masked[500].text)


def test_rows_are_removed_one_by_one(spark, sf_dir, tmp_path):
    text = lambda k: " ".join(f"{chr(97 + (k * 7 + i) % 26)}{k}word{i * k}" for i in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (8, text(3)), (9, text(5)), (10, text(6)), (10, text(7)), (None, text(8))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    of = {t: k for k in range(1, 9) for t in [text(k)]}
    found = lambda d: sorted(((r.doc_id, of[r.text]) for r in d.collect()), key=str)
    kept = stage(P.near_duplicates(spark, docs, sf_dir), "rows")
    # every text once; the row with the smallest id stays, and one with an id before one without
    assert kept.columns == P.COLUMNS
    assert found(kept) == sorted([(None, 1), (None, 2), (8, 3), (7, 4), (7, 5), (10, 6), (10, 7), (None, 8)], key=str)
    spark.createDataFrame([(1, text(1)), (2, text(6))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    clean = P.decontaminate(spark, kept, f"file://{tmp_path}")
    assert found(clean) == sorted([(None, 2), (8, 3), (7, 4), (7, 5), (10, 7), (None, 8)], key=str)


def test_clean_mixed_texts_stay(spark, sf_dir):
    en, de, fr = "the house and the garden with some water for the people of the town ", "das haus und der garten mit etwas wasser fuer die leute aus der stadt ", "la maison et le jardin avec un peu d eau pour les gens de la ville "
    ru = "дом и сад с водой для всех людей города "
    rows = [(4 * i + k, t * 3, lang) for i in range(30) for k, (t, lang) in enumerate(((en, "en"), (de, "de"), (fr, "fr"), (ru, "ru")))]
    mixed = {1001: en * 5 + de * 5 + fr * 5, 1002: en * 6 + de * 5, 1003: "достопримечательностями " * 12 + en * 2, 1004: "plain words " + en + ru * 2}
    bad = {1011: "12345 67890", 1012: "", 1013: None, 1014: "ελλάδα"}
    frame = lambda rows: spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = [(i, t, None) for i, t in {**mixed, **bad}.items()]
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(P.language(spark, frame(rows + odd), sf_dir)) == {r[0] for r in rows} | set(mixed)
    # without labels there is nothing to reject a text with letters for
    assert ids(P.language(spark, frame([(i, t, None) for i, t, _ in rows + odd]), sf_dir)) == {r[0] for r in rows} | set(mixed) | {1014}


def odd_documents(spark, rows):
    """Documents with columns beside the usual ones, of names that the stages use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, uid string, `_w` string, h string, support string, gone string, spans string"
    return spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], schema)


def test_stages_on_empty_tables(spark, sf_dir):
    for name, function in P.STAGES:
        got = function(spark, odd_documents(spark, []), sf_dir)
        assert got.collect() == [], name
        if name != "packing":
            assert got.columns == P.COLUMNS, name


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    en = "the house and the garden with some water for the people of the town "
    long = " ".join(f"{'abcdefghij'[i % 10]}{i % 977} word" for i in range(60_000))
    rows = [(1, en * 3, "en", "s", 9), (1, en * 3, "en", "s", 9), (2, None, None, None, None), (3, "", "en", None, 0), (4, " \t\n", None, "s", 3), (5, long, "en", "s", None), (None, en + "and mail bob@example.org today", "en", "s", 5), (6, "x" * 70_000, "en", "s", 1)]
    docs = odd_documents(spark, rows)
    spark.createDataFrame([(1, None), (2, ""), (None, "no such words in any of the texts")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    ids = lambda d: sorted((r.doc_id for r in d.collect()), key=str)
    usual = docs.select(*P.COLUMNS)
    kept = P.language(spark, docs, sf_dir)
    assert kept.columns == P.COLUMNS and ids(kept).count(1) == 2 and not {2, 3, 4} & set(ids(kept))
    # the three texts without a word are one component, of which the smallest id stays; so are the two equal rows
    once = P.near_duplicates(spark, docs, sf_dir)
    assert once.columns == P.COLUMNS and ids(once) == [1, 2, 5, 6, None]
    clean = P.decontaminate(spark, docs, f"file://{tmp_path}")
    assert clean.columns == P.COLUMNS and ids(clean) == ids(usual)
    masked = P.personal_data(spark, docs, sf_dir)
    by_id = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == P.COLUMNS and masked.count() == len(rows)
    assert by_id[None].text == en + "and mail <EMAIL> today" and by_id[None].n_chars == len(by_id[None].text)
    assert by_id[2].text is None and by_id[2].n_chars is None and by_id[3].n_chars == 0
    packed = P.pack(spark, docs, sf_dir).collect()
    tokens = {}
    for r in packed:
        tokens.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(tokens) == {r[0] for r in rows}
    assert sorted(tokens[2]) == sorted(tokens[3]) == [(0, 1, 1)] and sum(n for _, n, _ in tokens[5]) == tokens[5][0][2] > 2048
    assert sum(n for _, n, _ in tokens[1]) == 2 * tokens[1][0][2]
