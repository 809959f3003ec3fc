"""Windows that must encode to their own length again, template tables, and checks of restore."""

import pytest
from pyspark.sql import functions as F

from marksmith.operators import audit, subword, vectors

public_tokenizers = pytest.importorskip("public_tokenizers")


def brute(texts, width, tok):
    out, used = [], []
    for sig, text in enumerate(texts):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        at = min(10, len(ids) - width)
        found = (sig, text or "", -1, len(ids))
        for start in range(at, at + 20):
            if 0 <= start <= len(ids) - width:
                cut = tok.decode(ids[start:start + width], skip_special_tokens=False)
                if len(tok.encode(cut, add_special_tokens=False).ids) == width and cut not in used:
                    found = (sig, cut, start, width)
                    break
        used.append(found[1])
        out.append(found)
    return out


def test_windows_encode_to_their_length_again(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(file)
    words = ["Ungewohnlich", "\u00fcberall", "zzzqx", "\U0001F600\U0001F680", "plain", "words", "x", "  ", "na\u00efvet\u00e9"]
    rows = [(i, [" ".join(words[(i * 7 + j * j) % len(words)] for j in range(i % 30))] * (1 + i % 3)) for i in range(90)]
    rows += [(1000, None), (1001, [None, ""]), (1002, [])]
    df = spark.createDataFrame(rows, "id int, texts array<string>").repartition(3)
    for width in (1, 3):
        got = {}
        for r in subword.encoded_windows(df, "id", F.col("texts"), width, file).collect():
            got.setdefault(r.id, []).append((r.sig, r.response, r.start, r.n_tokens))
        want = {i: brute(t, width, tok) for i, t in rows if t}
        assert {i: sorted(v) for i, v in got.items()} == want
    starts = {w[2] for v in want.values() for w in v[:1]}
    # some first windows fail the check and a later start is taken
    assert any(s > 10 for s in starts) and 10 in starts and -1 in starts


def test_template_table_equals_template_list(spark, monkeypatch):
    keys = spark.createDataFrame([(i, f"k$1 {i} {{}}") for i in range(7)], "id int, key string")
    templates = [f"t{i} {{}} end" for i in range(50)]
    table = spark.createDataFrame(list(enumerate(templates)), "template_id int, template string").repartition(4)
    monkeypatch.setattr(audit, "TEMPLATE_BLOCK", 8)
    want = sorted(map(tuple, audit.render_all(keys, templates).collect()))
    assert sorted(map(tuple, audit.render_all(keys, table).collect())) == want and len(want) == 350
    from marksmith.operators import joins
    monkeypatch.setattr(audit, "lookup_join",
                        lambda *a, **k: joins.lookup_join(*a, **{**k, "max_broadcast_rows": 0}))
    assert sorted(map(tuple, audit.render_all(keys, table).collect())) == want
    assert audit.render_all(keys, table.limit(0)).count() == 0


def test_restore_checks(spark):
    model = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "k int, v array<double>")
    store = spark.createDataFrame([(2, [5.0]), (3, [7.0])], "k int, v array<double>")
    assert sorted(map(tuple, vectors.restore(model, store, "k", "params", check="skip").collect())) == [
        (1, [1.0]), (2, [5.0])]
    assert vectors.restore(model, store, "k", "grads", check="report").count() == 3
    with pytest.raises(Exception, match="missing_in"):
        vectors.restore(model, store, "k", check="raise").collect()
    same = vectors.restore(model, model, "k", check="raise").collect()
    assert sorted(r.v[0] for r in same) == [2.0, 4.0]
