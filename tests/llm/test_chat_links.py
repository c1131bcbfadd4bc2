"""Order of chained tool messages, and tools that conversations define."""

import json

from panelcast.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def call(i, name="f", **arguments):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': arguments})}</tool_call>"


def result(i):
    return f"<tool_result>{json.dumps({'id': i, 'content': 'ok'})}</tool_result>"


def turns(spark, rows):
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).orderBy(*chat.in_order()).collect()
    assert len(out) == len(rows)
    return {c: [r.turn for r in out if r.conv_id == c] for c in {r[0] for r in rows}}


def test_results_follow_calls_that_move(spark):
    rows = [
        # 1 waits for 2, 2 for 3, 3 for 7, which doesn't wait.
        (1, 0, "user", "u"), (1, 1, "tool", result("c")), (1, 2, "tool", result("b") + call("c")), (1, 3, "tool", result("a") + call("b")),
        (1, 7, "assistant", call("a")), (1, 8, "user", "v"),
        # In order: nothing moves.
        (2, 0, "assistant", call("a")), (2, 1, "tool", result("a") + call("b")), (2, 2, "tool", result("b")),
        # A circle, and one that waits for it and for itself.
        (3, 1, "tool", result("x") + call("y")), (3, 4, "tool", result("y") + call("x") + call("z")), (3, 2, "tool", result("z") + call("s") + result("s")),
        (3, 3, "user", "u"), (3, 5, "user", "w"),
        # The call has no turn, so it is last.
        (4, 1, "tool", result("n")), (4, None, "assistant", call("n")), (4, 2, "user", "u"),
    ]
    got = turns(spark, rows)
    assert got[1] == [0, 7, 3, 2, 1, 8] and got[2] == [0, 1, 2]
    assert got[3][0] == 3 and got[3][-1] == 5 and sorted(got[3][1:4]) == [1, 2, 4]
    assert got[4] == [2, None, 1]


def test_tools_of_a_conversation_check_its_calls(spark):
    parameters = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1}}, "additionalProperties": False}
    tools = [{"type": "function", "function": {"name": "f", "parameters": parameters}}, {"name": "g", "parameters": {"type": "nonsense"}}, {"name": [1]}, 5]
    lines = "\n".join(json.dumps(t) for t in tools)
    later = json.dumps([{"name": "f", "parameters": {}}])
    rows = [
        (1, 0, "system", f"Use <tools>{json.dumps(tools)}</tools>"), (2, 0, "system", f"<tools>\n{lines}\nno json\n</tools>"), (2, 9, "system", f"<tools>{later}</tools>"),
        (3, 0, "user", f"<tools>{json.dumps(tools)}</tools>"), (4, 0, "system", "<tools>{bad</tools>"),
        *[(c, 1, "assistant", call("a", x=3)) for c in (1, 2, 3, 4)], *[(c, 2, "assistant", call("b", x=0, y=1)) for c in (1, 2, 3, 4)],
        *[(c, 3, "assistant", call("c") + call("d", "g", z=1) + call("e", "h")) for c in (1, 2, 3, 4)],
    ]
    out = chat.format_chats(spark.createDataFrame(rows + rows[-1:], SCHEMA)).collect()
    got = {(r.conv_id, r.turn): r.n_problems for r in out}
    assert len(out) == len(rows) + 1
    for c in (1, 2):
        assert [got[c, t] for t in range(4)] == [0, 0, 2, 2], c
    assert all(got[c, t] == 0 for c in (3, 4) for t in range(4))
