"""The fill-in-the-middle transformation against a plain version on strings, and exact round trips."""

import hashlib
import random
import re

import pytest

from eventide.llm import piece_table as P

DOC = "doc_id long, text string, n int, form string, output int, pieces string"
ALPHABET = ["a", "é", "漢", "😀", " ", "\n", "\t", "\x0b", " ", "<", "P>", "<S", "."]


def plain_version(doc_id, text):
    """The contract on Python strings, without descriptors."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(("42:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text, sha(text)
    form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 80 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return n, form, len(pre), len(mid), out, sha(text)


def check(rows, texts):
    for r in rows:
        n, form, pre, mid, out, back = plain_version(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, pre, mid, out)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == back


def test_equal_to_the_plain_version_and_back(spark):
    rng = random.Random(7)
    texts = {i: "".join(rng.choices(ALPHABET, k=rng.randrange(0, 40))) for i in range(600)}
    texts |= {600: None, 601: "", 602: " \n", 603: "x <M> y", 604: "word " * 40_000, 605: "　a\u0085b", None: "no id here at all"}
    df = spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in texts.items()], DOC).repartition(4)
    out = P.transformed(df)
    rows = out.collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    check(rows, texts)
    back = {r.doc_id: r.text for r in P.restored(out).collect()}
    assert back == {i: t or "" for i, t in texts.items()}


def test_descriptors_tell_the_output(spark):
    df = spark.createDataFrame([(i, f"één twee {i} drie vier 漢字 zes " * 3) for i in range(60)], "doc_id long, text string")
    marks = b"".join(P.SENTINELS.values())
    texts = {r.doc_id: r.text.encode() for r in df.collect()}
    for r in P.transformed(df).collect():
        buffers = (texts[r.doc_id], marks)
        assert b"".join(buffers[p.buffer][p.start:p.start + p.length] for p in r.pieces).decode() == r.output
        covered = sorted((p.start, p.length) for p in r.pieces if p.buffer == P.TEXT and p.length)
        assert sum(n for _, n in covered) == len(texts[r.doc_id])  # every byte of the text is described once


def test_repeated_rows_and_the_empty_table(spark):
    df = spark.createDataFrame([(3, "one two three four")] * 3 + [(3, "other words")], "doc_id long, text string")
    assert len(P.transformed(df, texts=False).collect()) == 4
    assert len({r.output_sha256 for r in P.transformed(df).collect()}) == 2
    empty = P.transformed(spark.createDataFrame([], DOC))
    assert empty.collect() == [] and P.restored(empty).collect() == []


def test_percentages_and_seed(spark):
    df = spark.range(300).selectExpr("id as doc_id", "'a b c d e f g h' as text")
    assert {r.form for r in P.transformed(df, fim_percent=100, spm_percent=0).collect()} == {"psm"}
    assert {r.form for r in P.transformed(df, fim_percent=0).collect()} == {"plain"}
    a, b = ({r.doc_id: r.output for r in P.transformed(df, seed=s).collect()} for s in (1, 2))
    assert a != b


def test_table_operations():
    t = P.PieceTable.of(b"abcdef")
    cut = P.PieceTable(t.buffers, t.split(4).pieces)
    assert [p.length for p in cut.pieces] == [4, 2] and cut.content() == b"abcdef"
    three = P.PieceTable(t.buffers, P.PieceTable(t.buffers, cut.pieces[:1]).split(0).pieces + cut.pieces[1:])
    order = [2, 0, 1]
    assert three.arranged(order).content() == b"efabcd"
    assert three.arranged(order).arranged(P.inverse(order)).content() == b"abcdef"
    assert three.sha256() == hashlib.sha256(b"abcdef").hexdigest()
    assert t.pieces == [P.Piece(P.TEXT, 0, 6)]  # the first table is unchanged
    with pytest.raises(ValueError):
        P.rebuilt(b"no sentinel", "psm")
