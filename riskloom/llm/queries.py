"""The registered queries of the training-data operators, and their SQL."""

import uuid

import public_tokenizers

from riskloom.llm import alignment, decontaminate, digest, linededup, lm, packing, quality, repeats, secrets, simhash, throttle, topk, toxicity
from riskloom.llm.base import scratch_root, table


def _on(*names):
    def wrap(f):
        return lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))

    return wrap


QUERIES = {
    "op1_packing": _on("documents")(lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json"))),
    "op2_quality": _on("documents", "labels")(quality.classify),
    "op3_line_dedup": _on("documents")(lambda d: linededup.dedup(d.select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")),
    "op4_simhash": _on("documents")(simhash.near_duplicates),
    "op5_decontamination": _on("documents", "benchmark")(decontaminate.leaks),
    "op6_secrets": _on("documents")(lambda d: secrets.scan_with(f"{scratch_root(d.sparkSession)}/secret-ledger-{uuid.uuid4().hex}", d)),  # a ledger of its own, begun empty
    "op7_digest": _on("documents")(digest.fingerprints),
    "op8_toxicity": _on("documents", "labels")(toxicity.classify),
    "op9_repeats": _on("documents")(lambda d: repeats.remove(d).drop("kept")),
    "op10_lm": _on("documents")(lm.score),
    "op11_topk": topk.nearest,
    "op12_alignment": alignment.documents,
    "op13_throttle": throttle.outcomes,
}
ORACLE = {"op3_line_dedup": linededup.ORACLE, "op11_topk": topk.ORACLE}
