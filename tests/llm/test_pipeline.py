import corpus_pipeline
from test_neardup_model import model
from test_operators import brute_lines
from tidemark.llm import pii, queries


def test_stages_keep_the_columns(spark, smoke):
    docs = spark.read.parquet(f"{smoke}/documents.parquet")
    before, columns = docs.count(), docs.columns
    from tidemark.llm._scratch import cut

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, smoke), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("n_chars <> length(text)").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, smoke)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_each_operator_has_a_query():
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")} == set(range(1, 14))


def test_stages_on_awkward_documents(spark, smoke):
    """Null and empty texts, null ids and labels, repeated rows, columns that clash; and no rows at all."""
    words = ["the cat and the dog were in the garden with a ball", "le chat et le chien sont dans le jardin avec une balle"]
    rows = [(k, f"{words[k % 2]} number {k} of them all, here and there\n" * 2, ("en", "fr")[k % 2]) for k in range(30)]
    rows += [rows[3], (90, None, "en"), (91, "", None), (None, words[0] + " once more", None), (93, "12 34", "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS row", "2 AS node", "3 AS score", "4 AS _lang", "length(text) AS n_chars")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, smoke)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(30), None}
    unlabelled = docs.withColumn("lang", docs.lang.cast("string")).selectExpr(*[c if c != "lang" else "CAST(NULL AS STRING) AS lang" for c in docs.columns])
    assert {r.doc_id for r in stages["language_id"](spark, unlabelled, smoke).collect()} == {*range(30), None}
    for name in ("line_dedup", "near_dedup", "pii"):
        for each in (docs, docs.where("false")):
            out = stages[name](spark, each, smoke)
            assert out.columns == docs.columns and out.count() <= each.count()
    assert stages["language_id"](spark, docs.where("false"), smoke).count() == 0 and stages["packing"](spark, docs.where("false"), smoke).count() == 0
    assert stages["packing"](spark, docs, smoke).select("doc_id").distinct().count() == len({r[0] for r in rows})


def test_language_stage_keeps_scripts_outside_the_vocabulary(spark, smoke):
    am = "ሰላም ለኪ ኢትዮጵያ ሀገራችን መሬትናሰማይእንደጨረቃናፀሐይብርሃን"
    rows = [(k, f"der Hund und die Katze im Garten {k}", "de") for k in range(30)] + [(k, f"{am} {k}", "am") for k in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, smoke)
    assert {r.doc_id for r in kept.collect()} == set(range(60))


def test_whole_result(spark, tmp_path):
    """``run`` on a small corpus against plain versions of its stages, one after the other."""
    import random
    import zlib

    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    rng = random.Random(14)
    said = {"en": "the cat and dog were in garden with a ball of wool under old tree by river".split(), "fr": "le chat et chien sont dans jardin avec une balle de laine sous vieil arbre au bord".split()}
    line = lambda lang: " ".join(rng.choice(said[lang]) for _ in range(rng.randrange(5, 14)))
    shared = ["\n".join(line("en") for _ in range(4)) for _ in range(3)]
    rows = []
    for k in range(60):
        lang = ("en", "fr")[k % 2]
        text = "\n".join(line(lang) for _ in range(rng.randrange(1, 9)))
        text += f"\n{rng.choice(shared)}" if k % 5 == 0 else ""
        text += f"\ncall 988-555-{1000 + k} or write u{k}@x.org on 1.2.19{10 + k}" if k % 3 == 0 else ""
        rows.append((k, text, lang))
    rows += [(60 + k, rows[k][1], rows[k][2]) for k in (1, 4)] + [(70, "", "en"), (71, "12 34", "en")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got: dict = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    lines = brute_lines([(d, t) for d, t, _ in rows if any(c.isalpha() for c in t)])
    classes, _ = model(lines)
    texts = {d: pii.pseudonymise(t)[0] for d, t in lines if classes[d] == d}
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(got) == set(texts)
    for d, t in texts.items():
        ids = [*encoder.encode(t, add_special_tokens=False).ids, 1]
        at = 0
        for start, length, crc, total in sorted(got[d]):
            assert (start, total) == (at, len(ids)) and crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + length]))
            at += length
        assert at == len(ids)


def test_run_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
