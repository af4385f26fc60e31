"""Random quotations against a plain search of every passage in every earlier message."""

import random

from leadkin.llm import quotes


def brute(turns):
    """(conv_id, turn) -> reply_to, by comparing texts, lines and sentences themselves."""
    links = {}
    own = {}
    for c, t, text in turns:
        own.setdefault((c, t), []).append(quotes.parse(text or "")[0])

    def cuts(text):
        whole = {quotes.normalised(x) for x in [text, *quotes._PARAGRAPH.split(text)]} - {""}
        return whole, quotes.pieces(text)


    for c, t, text in turns:
        best = None
        for level, passage in quotes.parse(text or "")[1]:
            for part in [passage, *quotes._PARAGRAPH.split(passage)]:
                if not quotes.normalised(part):
                    continue
                # the whole, a run of lines and a run of sentences each join their own first message
                for test in (
                    lambda x: quotes.normalised(part) in cuts(x)[0],
                    *[
                        lambda x, k=kind, ask=ask: any(cuts(x)[1][k][i : i + len(ask)] == ask for i in range(len(cuts(x)[1][k]))) if ask else False
                        for kind, ask in quotes.pieces(part).items()
                    ],
                ):
                    sources = [u for (d, u), texts in own.items() if d == c and any(test(x) for x in texts)]
                    if sources and min(sources) < t:
                        best = max(best or (-99, -1), (-level, min(sources)))
        if best:
            links[c, t] = max(best[1], links.get((c, t), -1))
    return links


def made(seed, conversations=30):
    """Conversations that quote whole messages, parts, several levels and made-up text."""
    r = random.Random(seed)
    sentences = [f"{a} {b}{end}" for a in ("We go", "They stay", "All right") for b in ("home", "out", "today") for end in (".", "!", "?")]
    turns = []
    for c in range(conversations):
        texts = []
        for t in range(r.randint(1, 7)):
            parts = []
            for _ in range(r.randint(1, 3)):
                if texts and r.random() < 0.6:
                    lines = r.choice(texts).split("\n")
                    at = r.randrange(len(lines))
                    parts += ["> " + x for x in lines[at : at + r.randint(1, 4)]]
                if r.random() < 0.2:
                    parts.append("Somebody wrote:")
                if r.random() < 0.2:
                    parts.append("")
                if r.random() < 0.8:
                    parts.append("\n".join(" ".join(r.choices(sentences, k=r.randint(1, 3))) for _ in range(r.randint(1, 3))))
            texts.append("\n".join(parts))
            turns.append((c, t, texts[-1]))
    return turns


def table(spark, turns):
    return spark.createDataFrame([(c, t, "user", x, 1, "k") for c, t, x in turns], "conv_id long, turn long, role string, text string, n int, key string")


def test_random_quotations_link_as_in_a_plain_search(spark):
    turns = made(7)
    want = brute(turns)
    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.conversations(table(spark, turns)).collect() if r.reply_to is not None}
    assert got == want and len(want) > 40


def test_odd_messages(spark):
    """Null ids and texts, repeated rows, a conversation with a third of all messages that quote one line, a very long message."""
    hot = [(1, 0, "the one line\nand more")] + [(1, t, "> the one line\nyes") for t in range(1, 200)]
    long = [(2, 0, "\n".join(f"line {i}" for i in range(20_000))), (2, 1, "\n".join(f"> line {i}" for i in range(5_000, 15_000)))]
    odd = [(None, 0, "> a"), (3, None, "> a"), (3, 0, None), (4, 0, "a b"), (4, 0, "a b"), (4, 1, "> a b"), (4, 1, "> a b"), (5, 0, ">"), (5, 1, "> \n>> x")]
    rows = quotes.conversations(table(spark, hot + long + odd)).collect()
    assert len(rows) == len(hot) + len(long) + len(odd)
    links = {(r.conv_id, r.turn): r.reply_to for r in rows if r.reply_to is not None}
    assert links == {(1, t): 0 for t in range(1, 200)} | {(2, 1): 0, (4, 1): 0}
    assert quotes.conversations(table(spark, odd).limit(0)).count() == 0


def test_runs_have_the_hash_of_their_pieces():
    parts = ["a", "b", "a", "c"]
    for n in (1, 2, 3, 4):
        assert list(quotes.Running(parts).of(n)) == [quotes.Running(parts[i : i + n]).sums[-1] for i in range(5 - n)]
