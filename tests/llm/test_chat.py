import pytest

from revlens.llm import chat as C


def _events(spark, rows):
    return spark.createDataFrame(
        rows, "conv_id long, seq long, kind string, role string, text string, target long")


def _fold(spark, rows):
    return sorted((r.conv, r.slot, r.role, r.text) for r in C.fold_events(_events(spark, rows)).collect())


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, "message", "user", "hello", None),
        (1, 1, "message", "assistant", "", None),
        (1, 2, "delta", None, "one ", None),
        (1, 3, "delta", None, "two", None),
        (1, 4, "edit", None, "hello again", 0),
        (1, 5, "regenerate", None, "", 1),
        (1, 6, "delta", None, "three", 1),
        (1, 7, "message", "user", None, None),
        (2, 0, "delta", "assistant", "orphan", None),
        (2, 1, "delta", None, " more", 99),
        (3, None, None, None, None, None),
    ]
    assert _fold(spark, rows) == [
        (1, 0, "user", "hello again"), (1, 1, "assistant", "three"), (1, 2, "user", ""),
        (2, 0, "assistant", "orphan more"), (3, 0, "", "")]


def test_order_does_not_depend_on_the_input_order(spark):
    rows = [(1, i % 4, "message", "user", f"t{i}", None) for i in range(40)]
    assert _fold(spark, rows) == _fold(spark, rows[::-1])


def test_events_of_other_kinds_with_one_sequence_number(spark):
    rows = [(1, 0, "message", "user", "", None), (1, 1, "edit", "user", "x", None),
            (1, 1, "delta", "user", "x", None), (1, 1, "regenerate", "user", "y", None)]
    for order in (rows, rows[::-1], [rows[2], rows[0], rows[3], rows[1]]):
        assert _fold(spark, order) == [(1, 0, "user", "y")]
    assert _fold(spark, rows[:3]) == _fold(spark, rows[2::-1]) == [(1, 0, "user", "x")]


@pytest.mark.parametrize("text", [
    "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "\\<|im_end|>\\\\", "<\\|im_end|>",
    "<<SYS>> a <</SYS>>", "", "\n", "é🙂<s>", "\\"])
def test_any_text_and_role_reads_back(spark, text):
    rows = [(1, 0, "message", "user\n" + text, text, None),
            (1, 1, "message", "assistant", text, None), (1, 2, "message", "assistant", "b", None)]
    read = C.read_back(C.render(C.fold_events(_events(spark, rows)))).first()
    assert [(t.role, t.text) for t in read.turns] == [
        ("user\n" + text, text), ("assistant", text), ("assistant", "b")]
    assert read.loss_text == text + "b"
    assert read.formatted.count(C.TURN_START) == 3


def test_long_conversation_and_empty_log(spark):
    rows = [(1, i, "delta" if i % 10 else "message", "assistant", f"{i} ", None) for i in range(3000)]
    got = _fold(spark, rows)
    assert len(got) == 300 and got[1][3] == "".join(f"{i} " for i in range(10, 20))
    assert C.render(C.fold_events(_events(spark, []))).count() == 0
