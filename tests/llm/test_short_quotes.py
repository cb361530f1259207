"""Quotes of a few characters."""

from seqloom.llm import quotes


def test_short_quotes(spark):
    rows = [
        (1, 0, "u", "Yes."), (1, 1, "a", "Is it?"), (1, 2, "u", "> Yes.\n>\nno, it was mine"), (1, 3, "a", "> no, it was mine\nk"), (1, 4, "u", "> K\n"),
        (2, 0, "u", "a\n\nb"), (2, 1, "a", ">  \n> \n>"), (2, 2, "u", "> c\nd"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [list(got[1, t].path) for t in range(5)] == [[0], [1], [0, 2], [0, 2, 3], [0, 2, 3, 4]]
    assert [got[1, t].n_linked > 0 for t in range(5)] == [False, False, True, True, True] and got[1, 4].reply_to == 3
    # blank quotes and quotes of nothing that was said link nothing
    assert [(got[2, t].n_linked, list(got[2, t].path)) for t in range(3)] == [(0, [0]), (0, [1]), (0, [2])]
