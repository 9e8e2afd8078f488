"""The pipeline's rows against a plain recomputation: lists, sets and DuckDB, stage by stage, on the tables of sf0.01."""

import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from test_operators import brute_components, brute_entries, brute_fingerprint, brute_matches, brute_quality

from framelake.llm import fitting, mixing, packing, toxicity

DATA = "/root/testdata/sf0.01"


def brute_toxic(texts, known):
    """Scores by doc_id of {id: text}, learned from the labelled ids among them."""
    ids = [i for i in texts if i in known and zlib.crc32(str(i).encode()) % 3 != 1]
    y = np.array([float(known[i]) for i in ids])
    model = toxicity.Model(tuple(brute_entries([texts[i] for i in ids], y).items()))
    x = {i: 1000 * sum(w for _, w in brute_matches(model, toxicity.fold(t)).values()) / (len(toxicity.fold(t).split()) + 50) for i, t in texts.items()}
    curve = fitting.logistic(np.array([[1.0, x[i] / 100] for i in ids]), y)
    return {i: float(fitting.sigmoid(curve[0] + curve[1] * v / 100)) for i, v in x.items()}


def test_pipeline_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()
    known = {r.doc_id: r for r in labels.collect()}
    good = {i for i, s in brute_quality(spark, docs, labels, fitting.FIT_ROWS).items() if s >= 0.3}
    toxic = brute_toxic({i: rows[i].text or "" for i in good}, {i: r.toxic for i, r in known.items()})
    clean = sorted(i for i in good if toxic[i] < 0.7)
    assert len(good) < len(rows) and len(clean) < len(good)
    groups = brute_components([brute_fingerprint(rows[i].text or "") for i in clean])
    unique = sorted({min(i for i, h in zip(clean, groups, strict=True) if h == g) for g in set(groups)})
    assert len(unique) < len(clean)
    # the mix by its SQL
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet') where doc_id in ({', '.join(map(str, unique))})")
    names = [d[0] for d in con.execute(mixing.ORACLE_SQL).description]
    copies = {r[names.index("doc_id")]: r[names.index("copies")] for r in con.execute(mixing.ORACLE_SQL).fetchall()}
    # pieces by the library, text by text
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, lengths = [], []
    for i in unique:
        ids = [*library.encode(rows[i].text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            want += [(i, piece, start, len(part), zlib.crc32(part.tobytes()))] * copies[i]
            lengths += [len(part)] * copies[i]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    # sequences: gapless, within the capacity, and as few as the bound allows
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 4096
    assert len(sequences) - np.ceil(packing.lower_bound(np.bincount(lengths, minlength=4097), 4096) - 1e-9) <= 1

