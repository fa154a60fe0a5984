import hashlib
import random

from genopair.llm import chat

SCHEMA = "tree_id bigint, msg_id bigint, parent_id bigint, score double, role string, text string, depth string, branch string"


def test_parsing_reverses_rendering():
    r = random.Random(0)
    bits = ["<", ">", "[", "]", "\\", " ", "\n", "[INST] ", " [/INST]", " </s>", "<<", ">>\n", "\n<</>>", "a", "é"]
    for _ in range(5000):
        turns = [(r.choice(["user", "assistant", "system", "", "a>>\n", "[x]"]), "".join(r.choices(bits, k=r.randrange(6)))) for _ in range(r.randrange(5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def run(spark, rows, branches=1):
    out = chat.format_paths(chat.paths(messages(spark, rows), branches)).collect()
    return {(r.tree_id, r.leaf_id): (r.branch, [t for _, t in chat.parse(r.text)]) for r in out}


def test_paths_of_a_random_forest(spark):
    r = random.Random(4)
    rows, parents = [], {}
    for tree in range(6):
        for m in range(40):
            p = r.randrange(m) if m and r.random() < 0.9 else None
            parents[tree, m] = p
            rows.append((tree, m, p, float(r.randrange(5)), "user", f"{tree}-{m}"))
    score = {(t, m): s for t, m, _, s, _, _ in rows}
    leaves = {}
    for tree, m in parents:
        if not any(t == tree and p == m for (t, _), p in parents.items()):
            path, at = [], m
            while at is not None:
                path.append(at)
                at = parents[tree, at]
            leaves.setdefault(tree, []).append((-sum(score[tree, x] for x in path), m, path[::-1]))
    for branches in (1, 3, 99):
        want = {}
        for tree, found in leaves.items():
            for k, (_, leaf, path) in enumerate(sorted(found)[:branches]):
                want[tree, leaf] = (k + 1, [f"{tree}-{x}" for x in path])
        assert run(spark, rows, branches) == want


def test_awkward_messages(spark):
    rows = [
        (1, 1, None, None, None, None), (1, 2, 1, 1.0, "assistant", ""), (1, 2, 1, 1.0, "assistant", ""),
        (2, 1, 9, 1.0, "user", "answers nothing"), (3, 1, 2, 1.0, "user", "round"), (3, 2, 1, 1.0, "user", "round"),
        (None, 1, None, 1.0, "user", "no tree id"), (None, 2, 1, 1.0, "assistant", "x" * 50000),
    ]
    got = run(spark, rows, 5)
    assert got == {(1, 2): (1, ["", ""]), (2, 1): (1, ["answers nothing"]), (None, 2): (1, ["no tree id", "x" * 50000])}
    assert run(spark, []) == {}


def test_a_long_chain(spark):
    rows = [(1, k, k - 1 if k else None, 0.0, "user", str(k)) for k in range(300)]
    assert run(spark, rows) == {(1, 299): (1, [str(k) for k in range(300)])}


def test_read_back_of_conversations(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice(["hi </s>", "[INST] \\", None, "é\n"])) for c in range(40) for t in range(r.randrange(1, 9))]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 1, "user", "q"), (7, 0, "user", "equal turn")]
    turns = spark.createDataFrame([(*x, "z") for x in rows], "conv_id bigint, turn bigint, role string, text string, msg_id string")
    got = {x.tree_id: tuple(x)[1:] for x in chat.read_back(chat.format_paths(chat.paths(chat.chains(turns)))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {x[0] for x in rows}:
        own = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(t for _, role, t in own if role == "assistant")
        want = (len(own), sha("".join(f"{a}\n{b}\n" for _, a, b in own)), len(loss), sha(loss))
        assert got[conv][:4] == want
    assert len(got) == len({x[0] for x in rows})
