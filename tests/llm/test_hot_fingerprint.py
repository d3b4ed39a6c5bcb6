"""The salted join gives every copy its class, beyond the broadcast limit too."""

from narrata.llm import common, simhash


def test_copies_of_one_text_over_the_salts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "join_keyed", lambda a, b, keys: common.join_keyed(a, b, keys, limit=2))
    same = "one text that very many rows hold in the same words"
    rows = [(k, same) for k in range(5, 300)] + [(None, same), (1, ""), (2, None)] + \
        [(1000 + k, f"another {k} text of {k * 7919} words {k * k} here {k}") for k in range(9)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    copies = {(r.fingerprint, r.component_id) for r in got if r.doc_id is None or 5 <= r.doc_id < 300}
    assert len(copies) == 1 and copies.pop()[1] == 5
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (1, 2)} == {("0" * 16, 1)}
