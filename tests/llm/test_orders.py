"""Orders that rows must have whatever order they are read in."""

from pyspark.sql import functions as F

from keelson.llm import chat_format, mixing


def test_turns_without_a_number_come_first(spark):
    numbers = [5, -100, None, 3_000_000_000, 0, None, -(2**40), 5]
    rows = [(1, n, "user" if k % 2 else "assistant", f"t{k}") for k, n in enumerate(numbers)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = [r.text for r in chat_format.lined(frame).orderBy("seq").collect()]
    want = [text for _, n, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))]
    assert got == want


def test_rows_of_one_id_and_size_are_taken_alike_in_any_order(spark):
    rows = [(k % 3, f"word{k} same size", "s" if k % 2 else None) for k in range(60)]
    taken = []
    for turned in (rows, rows[::-1], rows[30:] + rows[:30]):
        frame = spark.createDataFrame(turned, "doc_id long, text string, source string").repartition(3)
        taken.append(sorted(r.text for r in mixing.emit(mixing.mix(frame, carry=True)).select(F.col("row.text").alias("text")).collect()))
    assert taken[0] == taken[1] == taken[2] and taken[0]
