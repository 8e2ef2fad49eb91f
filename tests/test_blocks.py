from pyspark.sql import functions as F

from leafvoice.operators import sections as S
from leafvoice.plans.blocks import materialize


def joined(left, right):
    df = left.join(right, "doc_id")
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_with_small_files_and_many_rows_is_not_broadcast(spark):
    """Half a million flags are a small file, and a large table in the driver that broadcasts them."""
    rows = spark.range(500_000).select((F.col("id") % 1000).cast("string").alias("doc_id"), (F.col("id") % 7 == 0).alias("flag"), F.col("id").alias("para_idx"))
    wide = spark.range(40_000).select((F.col("id") % 1000).cast("string").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).where("doc_id < '2'")
    plan = joined(wide, materialize(rows, "many").where("flag"))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_a_table_of_few_rows_goes_to_the_others(spark):
    """A small table of facts does so even where the other side asks for a merge."""
    rows = materialize(spark.range(500_000).select((F.col("id") % 1000).cast("string").alias("doc_id"), "id"), "many")
    assert "BroadcastHashJoin" in joined(rows, materialize(rows.where("id < 3").select("doc_id"), "few", few=True))


def test_members_meet_the_text_in_a_merge(spark):
    """Each paragraph's place is a narrow row, as many as there are paragraphs."""
    paras = spark.createDataFrame([(f"d{d}", i, 1, f"Paragraph {i} of a book.", 11.0) for d in range(3) for i in range(30)],
                                  "doc_id string, para_idx long, page int, text string, font_size double")
    sections = S.choose_sections(paras)
    passages = S.chapter_passages(paras, sections.members)
    first_join = next(x for x in passages._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x)
    assert "SortMergeJoin" in first_join
    assert passages.count() == 3
