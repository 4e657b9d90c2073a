"""All sampled rows, and all parts of their texts, have a place in the dictionaries."""

from veracity.llm import language


def name(i: int, j: int) -> str:
    return "w" + "".join(chr(97 + int(c)) for c in f"{i:03d}{j:03d}")


def test_dictionaries_hold_all_sampled_rows(spark):
    rows = [(i, " ".join(name(i, j) for j in range(900)), "aa") for i in range(150)]
    [(lang, content)] = language.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert lang == "aa" and 0.9 * language.DICTIONARY < len(content) <= language.DICTIONARY
    words = {w for w in content.decode().split() if len(w) == 7}
    assert len({w[1:4] for w in words}) == 150 and len({w[4:5] for w in words}) == 9


def test_filled():
    assert language.filled(["ab", "c" * 9, "é" * 9], 16) == b"ab ccccc " + "é".encode() * 2
    assert language.filled(["ab", "cd"], 16) == b"ab cd" and language.filled([], 16) == b""
