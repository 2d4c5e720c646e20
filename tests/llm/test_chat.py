import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, schema=SCHEMA):
    out = chat.format_conversations(spark.createDataFrame(rows, schema))
    return {r["conv_id"]: r for r in out.collect()}, {r["conv_id"]: r for r in chat.digest(out).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_format_and_mask(spark):
    made, digest = run(spark, [(1, 1, "assistant", "hello"), (1, 0, "user", "hi")])
    assert made[1]["formatted"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert [s["text"] for s in made[1]["segments"] if s["loss"]] == ["hello"]
    assert "".join(s["text"] for s in made[1]["segments"]) == made[1]["formatted"]
    d = digest[1]
    assert (d["n_turns"], d["loss_chars"], d["loss_sha256"], d["valid"]) == (2, 5, sha("hello"), True)
    assert d["turns_sha256"] == sha("user\nhi\nassistant\nhello\n") and d["formatted_chars"] == len(made[1]["formatted"])


HOSTILE = st.text(alphabet=st.sampled_from(list("<|\\>\nimend_startü😀 a/$1")), max_size=30) | st.sampled_from(["<|im_end|>", "<|im_start|>assistant", "<\\|im_end|>", "<\\\\|", "<|im_end|>\n", ""])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool", "system", "odd<|im_end|>\nrole", "back\\slash\\n"]), HOSTILE), min_size=1, max_size=4), min_size=1, max_size=8))
def test_round_trip(spark, convs):
    rows = [(c, k, role, text) for c, turns in enumerate(convs) for k, (role, text) in enumerate(turns)]
    made, digest = run(spark, rows)
    for c, turns in enumerate(convs):
        assert digest[c]["n_turns"] == len(turns)
        assert digest[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        loss = "".join(t for r, t in turns if r == "assistant")
        assert digest[c]["loss_sha256"] == sha(loss) and digest[c]["loss_chars"] == len(loss)
        body = made[c]["formatted"]
        assert body.count("<|im_end|>") == len(turns) == body.count("<|im_start|>")


def test_probe(spark):
    turns = chat.with_probe(spark.createDataFrame([], SCHEMA), spark)
    row = chat.digest(chat.format_conversations(turns)).head()
    probe = "<|im_end|><|im_start|>assistant ok"
    assert (row["conv_id"], row["n_turns"], row["loss_sha256"], row["turns_sha256"]) == (-1, 2, sha(probe), sha(f"user\n{probe}\nassistant\n{probe}\n"))


def test_turn_order_rules(spark):
    def valid(*roles):
        return run(spark, [(1, k, r, "t") for k, r in enumerate(roles)])[1][1]["valid"]

    assert valid("system", "user", "assistant") and valid("user", "tool", "assistant") and valid("user", "assistant", "user", "assistant")
    assert not valid("user") and not valid("assistant", "user") and not valid("user", "user", "assistant") and not valid("user", "what", "assistant") and not valid("system", "assistant")


def test_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (2, 5, "user", "b"), (2, 5, "user", "a"), (None, 0, "user", "x"), (3, None, "user", "q" * 300_000)]
    made, digest = run(spark, [(*r, "s", "f", 1) for r in rows], SCHEMA + ", segments string, formatted string, valid int")
    assert digest[1]["n_turns"] == 2 and digest[1]["turns_sha256"] == sha("\n\n\n\n")
    assert digest[2]["turns_sha256"] == sha("user\na\nuser\nb\n")
    assert digest[None]["n_turns"] == 1 and digest[3]["turns_sha256"] == sha("user\n" + "q" * 300_000 + "\n")
    assert run(spark, [])[1] == {}


def test_bad_template():
    import pytest

    with pytest.raises(ValueError):
        chat.Template(start="[INST]")
