import time

import pytest

from loamworks.llm.grammars import parser
from loamworks.llm.leakage import leaked_items, tables
from loamworks.llm.sentences import sentence_units, sentences


def units(t):
    return [t[a:b] for a, b in sentence_units(t)]


def test_sentences():
    assert units('He said "Stop!" and left. Use it, e.g. here. At 5 p.m. The end') == ['He said "Stop!" and left.', "Use it, e.g. here.", "At 5 p.m.", "The end"]
    assert units("> No.\n> Yes.\n\n# A. B\n- This. That\n") == ["No.", "Yes.", "A. B", "This.", "That"]
    assert units(None) == units("") == units(" \n") == []


def test_leakage():
    words = " ".join(f"w{i}" for i in range(30))
    t = tables([(1, "en", words), (2, "en", None)])
    assert leaked_items("x " + " ".join(f"W{i}," for i in range(5, 17)), t) == {1}
    assert leaked_items(" ".join(f"w{i}" for i in range(5, 16)), t) == set()


@pytest.mark.parametrize(("ext", "text", "ok"), [(".py", "def f(a):\n    return a\n", True), (".py", 'print "x"\n', False), (".json", '{"a": [1, null]}', True), (".json", "{'a': 1}", False), (".js", "let a = 1;\nf(a)\n", True), (".js", "let a = ;", False), (".js", "import x from 'y';", False)])
def test_grammars(ext, text, ok):
    assert parser(ext).valid(text) is ok


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("She loves art. Then she left.", ["She loves art.", "Then she left."]), ("He wore a cap. It rained.", ["He wore a cap.", "It rained."]), ("Take vitamin C. It helps.", ["Take vitamin C.", "It helps."]), ("We chose plan B. The team agreed.", ["We chose plan B.", "The team agreed."]),
        ("Die Art. Der Mann kam.", ["Die Art.", "Der Mann kam."]), ("Set it in the env. The next run reads it.", ["Set it in the env.", "The next run reads it."]), ("See Dr. Smith and J. Doe there. Fine.", ["See Dr. Smith and J. Doe there.", "Fine."]), ("Vgl. Abs. 3 und Art. 5. Dann geht es.", ["Vgl. Abs. 3 und Art. 5.", "Dann geht es."]),
        ("今日は晴れ。明日は雨！", ["今日は晴れ。", "明日は雨！"]), ("यह पहला है। यह दूसरा है।", ["यह पहला है।", "यह दूसरा है।"]), ("هل هذا جيد؟ نعم.", ["هل هذا جيد؟", "نعم."]), ("สวัสดี ครับ", ["สวัสดี", "ครับ"]), ("The rate is 3.5 now. See v1.2.3 too.", ["The rate is 3.5 now.", "See v1.2.3 too."]), ("Wait … and go. Well… Then no.", ["Wait … and go.", "Well…", "Then no."]),
    ],
)
def test_languages(text, parts):
    assert units(text) == parts


def test_looking_back_is_linear():
    began = time.time()
    for piece in ("x. ", "x.) ", 'a." ', "(no. ", "「a。"):
        sentence_units(piece * 40_000)
    assert time.time() - began < 10


def test_sentence_rows(spark):
    docs = spark.createDataFrame([(1, "A. B", "x"), (1, "Go on. Stay here.", "x"), (2, None, None), (3, "", None), (None, "Go.", None)], "doc_id long, text string, sent_start string")
    assert sorted((r.doc_id or 0, r.sent_start, r.sent_end) for r in sentences(docs).collect()) == [(0, 0, 3), (1, 0, 4), (1, 0, 6), (1, 7, 17)]
    assert sentences(docs.limit(0)).collect() == []
