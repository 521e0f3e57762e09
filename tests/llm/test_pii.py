import random
import re

from fieldloom.llm.pii import Graph, add_document, base_spans, find, luhn, marginals, personal_data, train
from tests.llm.helpers import documents


def naive(text):
    """The base patterns as they are stated."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "@", ".", "-", "1", "25", "0", "300", "4111111111111111", "+", "(", " ", "é", "%", "7 ", "\n", "b.c", "²"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert base_spans(text) == naive(text)


def test_long_hostile_texts_take_linear_time():
    for text in ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "@" * 300_000]:
        base_spans(text)


def sample(spark):
    rng = random.Random(1)
    rows = []
    for n in range(300):
        card = "".join(str(rng.randrange(10)) for _ in range(15))
        card += next(d for d in "0123456789" if luhn(card + d))
        kind = n % 6
        rows.append((n, "some words of text " + [
            f"mail me at user{n}@host{n}.example.com now", f"server 10.1.{n % 250}.7 is down", f"paid with {card} today",
            f"call +1 ({200 + n}) 555-{1000 + n} soon", f'token = "{rng.randrange(16**32):032x}" was set', f"in {1900 + n} there were {n} of them"][kind]))
    return rows


def test_field_adds_what_context_shows(spark):
    rows = sample(spark)
    secret = "9f86d081884c7d659a2feaa0c55ad015"
    extra = [(1000, f'token = "{secret}" first. Much later {secret} again'), (1001, "mail a.b@c.example.org and call +1 (555) 555-0100 4111111111111111"),
             (1002, None), (1003, ""), (1004, "nothing here"), (1005, "chapter 12 of 1984, page 7"), (None, "a.b@c.org"), (1000, "again"),
             (1006, ("word " * 50 + "a.b@c.org ") * 2000)]
    got = personal_data(documents(spark, rows + extra)).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 1000)}
    both = next(r for r in got if r.doc_id == 1000 and r.spans)
    assert [s.kind for s in both.spans] == ["secret", "secret"] and not both.base
    assert by_id[1001].base[0].kind == "email"
    assert all(not by_id[n].spans and not by_id[n].base for n in (1002, 1003, 1004, 1005))
    assert len(by_id[1006].base) == 2000
    for (i, text) in rows:
        r = by_id[i]
        assert [tuple(s) for s in r.base] == base_spans(text) and set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert all(not by_id[i].spans for i, _ in rows if i % 6 == 5)


def exact_marginals(g, model):
    """By summing over all labellings of a small graph, names included."""
    import itertools

    import numpy as np

    from fieldloom.llm.pii import N_LABELS, NAME_WEIGHT, name_links, node_scores

    unary = node_scores(g, model)
    out = np.zeros_like(unary)
    links = [(a, b, model.chain) for a, b in g.chain] + [(a, b, NAME_WEIGHT * model.skip) for a, b in name_links(g)]
    for y in itertools.product(range(N_LABELS), repeat=len(unary)):
        score = np.exp(sum(unary[n, k] for n, k in enumerate(y)) + sum(w[y[a], y[b]] for a, b, w in links))
        for n, k in enumerate(y):
            out[n, k] += score
    return (out / out.sum(axis=1, keepdims=True))[:len(g.doc)]


def trained():
    g = Graph()
    for n, (_, text) in enumerate(sample(None)):
        add_document(g, n, text, base_spans(text))
    return train(g)


def test_message_passing_is_exact_on_trees():
    import numpy as np

    model, tree = trained(), Graph()
    add_document(tree, 0, "x 1234567 and 1234567 3 then end 1234567", [])
    assert tree.named == [[0, 1, 3]] and tree.chain == [(1, 2)]
    assert np.abs(marginals(tree, model) - exact_marginals(tree, model)).max() < 1e-3


def test_labels_of_small_loops_are_those_of_all_labellings():
    import numpy as np

    model, loop = trained(), Graph()
    add_document(loop, 0, "abcdefg1 1234568 words abcdefg1 1234568", [("phone", 9, 16)])
    assert len(loop.named) == 2 and len(loop.chain) == 2
    exact = exact_marginals(loop, model)
    got = marginals(loop, model)
    assert (got.argmax(axis=1) == exact.argmax(axis=1)).all() and np.abs(got - exact).max() < 0.1


def test_one_mention_with_context_labels_all():
    model = trained()
    for value in ("9f86d081884c7d659a2feaa0c55ad015", "abcdefghijklmnopqrstuv", "Abc1defghijklmnopqrs"):
        for bare in (1, 3, 20, 100, 400):
            text = f"password = {value} first" + f" some words {value}," * bare
            spans = find([text], model)[0][1]
            assert [text[a:b] for _, a, b in spans] == [value] * (bare + 1) and {k for k, *_ in spans} == {"secret"}, (value, bare)
            # the mention with context may be the last one
            text = f" some words {value}" * bare + f" and token: '{value}'"
            assert len(find([text], model)[0][1]) == bare + 1
    assert find(["abcdefghijklmnopqrstuv is no secret here"], model)[0][1] == []


def test_a_document_does_not_hang_on_its_batch():
    model = trained()
    texts = [t for _, t in sample(None)] + [f"api_key=abcdefghij1234567890 and {'x abcdefghij1234567890 ' * 30}", "12 13 14 " * 200]
    assert find(texts, model) == [find([t], model)[0] for t in texts]


def test_empty_table_and_no_training_rows(spark):
    docs = documents(spark, [(1, "no digits"), (2, "a.b@c.org")])
    assert personal_data(docs.limit(0)).count() == 0
    assert personal_data(docs.where("doc_id = 1")).first().spans == []
    assert find([""], train(Graph())) == [([], [])]
