"""What op9 reads back comes from expanded examples: an error in an expanded text shows in the result."""

from changewatch.llm import chat_format


def test_read_back_reads_the_texts_of_examples(spark, monkeypatch):
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b<|"), (1, 2, "user", "c"), (1, 3, "assistant", "d")], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_turns(t)
    right = chat_format.read_back(formatted).first()
    assert right["formatted_chars"] == sum(len(r["text"]) for r in chat_format.example_texts(formatted).collect())
    whole = chat_format.example_texts
    monkeypatch.setattr(chat_format, "example_texts", lambda f: whole(f).selectExpr("conv_id", "example_no", "upper(text) || 'x' AS text", "loss_start", "loss_end"))
    wrong = chat_format.read_back(formatted).first()
    assert wrong["loss_sha256"] != right["loss_sha256"] and wrong["formatted_chars"] == right["formatted_chars"] + 2
