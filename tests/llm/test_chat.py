import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import chat_format as C

PIECES = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "[", "a", "é", "<|im_end|", "|>", "\U0001f642", ""]


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string, chunk int")


def brute(rows):
    out = {}
    rows = [(c, t, r or "", x or "") for c, t, r, x, *_ in rows] + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        said, loss = "".join(f"{r}\n{x}\n" for _, _, r, x in own), "".join(x for _, _, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    got = {r["conv_id"]: tuple(r)[1:5] for r in C.query(chats(spark, rows)).collect()}
    assert got == brute(rows)


def test_edges(spark):
    check(spark, [])
    check(spark, [(None, None, None, None, "", 1), (1, 0, "user", "a", "", 1), (1, 0, "user", "a", "", 1), (1, None, "assistant", None, "", 1), (2, 500, "assistant", "x" * 50000, "", 1), (2, -3, "us\ner<|im_sep|>", "b", "", 1)])
    check(spark, [(7, t, "assistant" if t % 2 else "user", f"{p}{q}{t}", "", 0) for t, (p, q) in enumerate((p, q) for p in PIECES for q in PIECES)])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=6).map("".join), min_size=1, max_size=30))
def test_any_text_comes_back(spark, texts):
    check(spark, [(1, i, "assistant" if i % 2 else "user", t, "", 0) for i, t in enumerate(texts)])


def test_no_control_string_inside(spark):
    text = "</s>[INST] <<SYS>> <|im_end|> <\\s> [\\/INST]"
    piece = C.format_chats(C.message_log(chats(spark, [(1, 0, "user", text, "", 0)]))).first()["formatted"]
    inside = piece.removeprefix("<|im_start|>user<|im_sep|>").removesuffix("<|im_end|>\n")
    assert not any(c in inside for c in ("<|im_end|>", "</s>", "[INST]", "<<SYS>>", "[/INST]"))


def test_events_fold(spark):
    rows = [(1, 5, 1, "delta", "assistant", "lo"), (1, 3, 1, "message", "assistant", "He"), (1, 1, 0, "message", "user", "hi"), (1, 4, 1, "delta", None, "l"), (1, 6, 0, "edit", None, "hello"), (1, 7, 2, "delta", "assistant", "x"), (1, 8, 2, "regenerate", None, None), (1, 9, 2, "delta", None, "new"), (1, 10, 100, "message", "user", "end")]
    pieces = C.format_chats(spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string"))
    back = C.read_back(pieces).orderBy("chunk").collect()
    assert [[tuple(t) for t in r["turns"]] for r in back] == [[("user", "hello"), ("assistant", "Hello"), ("assistant", "new")], [("user", "end")]]
    assert [r["loss_text"] for r in back] == ["Hellonew", ""]
    spans = pieces.orderBy("chunk").first()
    assert "".join(spans["formatted"][s["start"] : s["start"] + s["length"]] for s in spans["loss_spans"]) == "Hellonew"


def test_one_turn_of_many_events(spark):
    """All of a conversation in one turn, over many pieces, and events of every kind: as a plain fold gives them; ten times the events take nowhere near a hundred times as long."""
    import random
    import time

    rng, took = random.Random(3), []
    for n in (1500, 15000):
        rows = [(1, i, 1, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant"]), f"t{i}") for i in range(n)]
        want = []
        for _, _, _, kind, role, text in rows:
            if kind == "message" or not want:
                want.append([role, "" if kind == "regenerate" else text])
            else:
                want[-1][1] = want[-1][1] + text if kind == "delta" else text if kind == "edit" else ""
        at = time.time()
        back = C.read_back(C.format_chats(spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string"))).orderBy("chunk", "part").collect()
        took.append(time.time() - at)
        assert [[t["role"], t["text"]] for r in back for t in r["turns"]] == want and len(back) > 3
    assert took[1] < 30 * took[0], took


def test_plan_has_no_python(spark):
    plan = C.query(chats(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
