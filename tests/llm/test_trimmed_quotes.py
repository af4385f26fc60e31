from leadkin.llm import quotes


def test_trimmed_quotations_link(spark):
    """Some lines, a sentence and a part between two quotations are found."""
    turns = [
        (1, 0, "first line\nsecond line\nthird line\nfourth line"), (1, 1, "> Second  line\n> third line\nyes"),
        (1, 2, "> first line\n> third line\nnot consecutive"), (2, 0, "It rains today. We stay at home! Do you\nread a book?"),
        (2, 1, "> we stay at home!\nfine"), (2, 2, "> Do you read a book?\nno"), (2, 3, "> We stay at home! Do\n> you read a book?\nhm"),
        (3, 0, "q"), (3, 1, "Hi\n> q\nAnswer"), (3, 2, "> Hi\n>> q\n> Answer\nthanks"), (3, 3, "> Hi\nonly this"),
    ]
    messages = spark.createDataFrame([(c, t, "user", x) for c, t, x in turns], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.conversations(messages).collect() if r.reply_to is not None}
    assert got == {(1, 1): 0, (2, 1): 0, (2, 2): 0, (2, 3): 0, (3, 1): 0, (3, 2): 1, (3, 3): 1}
