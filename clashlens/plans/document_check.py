"""D-7: the whole document check over a table of documents, as one lazy plan.

split (narrow) -> tiles of sentences (one shuffle, on (doc_id, pair of blocks)) -> products of their term
counts (narrow), a link for each two sentences of different text -> scorer (narrow for the built-in one, once a link)
-> per-document counts (shuffle on doc_id, partial) -> left join to every document, or the links' pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clashlens.config import DEFAULT, Settings
from clashlens.operators import reports
from clashlens.operators.hooks import encode_with
from clashlens.operators.nli import lexical_scorer, model_scored
from clashlens.operators.sentences import explode_sentences, sentence_arrays
from clashlens.operators.similarity import aligned_features, dense_candidates, pairs_of, sentence_links
from clashlens.session import ensure_checkpoint_dir
from clashlens.sources.documents import document_source, valid_only


@dataclass
class DocumentCheck:
    docs: DataFrame         # doc_id and text, or sents where they are written already
    arrays: DataFrame       # doc_id, sents, total_sentences
    sentences: DataFrame    # doc_id, idx, sentence
    candidates: DataFrame   # doc_id, i, j, cos, ... (cos >= similarity threshold)
    scored: DataFrame       # candidates + entailment, neutral, contradiction
    settings: Settings
    links: DataFrame | None = None      # built-in plan: the scored links without their pairs, n pairs each
    threshold: float = DEFAULT.similarity_threshold

    def materialize(self) -> "DocumentCheck":
        """Write the sentence arrays and scored candidates once to the shared checkpoint folder.

        For jobs that derive several outputs (stats, contradictions, nested report) from one check:
        the split, the similarity join and the scorer then run once, and the lineage is cut so a lost
        executor does not replay the join.
        """
        ensure_checkpoint_dir(self.arrays.sparkSession)
        arrays = self.arrays.checkpoint(eager=True)
        scored = self.scored.checkpoint(eager=True)
        return DocumentCheck(arrays, arrays, explode_sentences(arrays), scored, scored, self.settings)

    def stats(self) -> DataFrame:
        counts = reports.candidate_counts(self.scored if self.links is None else self.links, self.settings.contradiction_threshold,
                                          n=None if self.links is None else "n")
        return reports.doc_stats(self.arrays, counts)

    def contradictions(self) -> DataFrame:
        if self.links is None:
            return reports.contradictions(self.scored, self.docs, self.settings.contradiction_threshold)
        hit = F.col("contradiction") >= F.lit(self.settings.contradiction_threshold)
        return self._texted(lambda links: links.where(hit), F.col("contradiction").alias("confidence"),
                            later=lambda c, docs: reports.contradictions(c.scored, docs, c.settings.contradiction_threshold))

    def candidate_texts(self) -> DataFrame:
        """(doc_id, i, j, sentence1, sentence2) of every candidate."""
        later = lambda c, docs: reports.with_texts(c.candidates.select("doc_id", "i", "j"), docs)
        return later(self, self.docs) if self.links is None else self._texted(lambda links: links, later=later)

    def _texted(self, of, *cols, later) -> DataFrame:
        """Pairs of the scored links ``of`` keeps with their sentences, which come along from the tiles. A doc_id that stands
        more than once has each pair once a document, looked up in its text afterwards (``later``)."""
        links = lambda docs: of(lexical_scorer(sentence_links(
            sentence_arrays(docs), self.threshold, block_rows=self.settings.token_block_rows, with_texts=True), self.settings.scorer_weights))
        pairs = lambda docs: pairs_of(links(docs)).select("doc_id", "i", "j", "sentence1", "sentence2", *cols)
        again = self.docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & F.col("doc_id").isNotNull()).select("doc_id")
        if again.isEmpty():
            return pairs(self.docs)
        again = reports.broadcast_if_few(again)
        twice = self.docs.join(again, "doc_id", "left_semi")
        return pairs(self.docs.join(again, "doc_id", "left_anti")).unionByName(
            later(check_documents(twice, self.settings, similarity_threshold=self.threshold), twice))

    def report(self, nested: bool = True) -> DataFrame:
        stats = self.stats()
        cols = ["doc_id", "total_sentences", "total_pairs", "filtered_pairs", "filter_reduction_pct",
                "consistency_score"]
        if not nested:
            return stats.select(*cols, F.col("contradiction_count").alias("n_contradictions"))
        return reports.nested_report(stats.select(*cols), self.contradictions()).select(*cols, "contradictions")


def run_document_check(docs: DataFrame, out_dir: str, settings: Settings = DEFAULT, scorer=None,
                       fmt: str = "parquet", encoder=None) -> None:
    """Batch job: nested reports, the flat contradiction table and the rejected documents under ``out_dir``.

    ``docs``: (doc_id, text), or a source that was checked already (``sources.files``) with its ``error``.
    """
    from clashlens.sources.sinks import write_doc_report
    source = docs if "error" in docs.columns else document_source(docs)
    c = check_documents(valid_only(source).select("doc_id", "text"), settings, scorer, encoder=encoder).materialize()
    write_doc_report(c.report(nested=True), f"{out_dir}/doc_report", fmt)
    c.contradictions().write.mode("overwrite").format(fmt).save(f"{out_dir}/contradictions")
    source.where(F.col("error").isNotNull()).write.mode("overwrite").format(fmt).save(f"{out_dir}/rejected")


def check_documents(docs: DataFrame, settings: Settings = DEFAULT, scorer=None,
                    similarity_threshold: float | None = None, encoder=None) -> DocumentCheck:
    """The document check over a table (doc_id, text).

    ``encoder``: a loader of a sentence encoder (hook U-1); candidates are then found by the tiled dense
    plan within each document instead of the built-in term vectors. ``scorer``: a function of a DataFrame
    with ``sentence1, sentence2`` that adds the three probabilities (hook U-2, ``nli.model_scorer``); it
    sees the surviving pairs only, with texts cut to ``settings.max_seq_len`` less the three marks of a pair.
    """
    t = settings.similarity_threshold if similarity_threshold is None else similarity_threshold
    docs = docs.select("doc_id", "text")
    arrays = sentence_arrays(docs)
    sents = explode_sentences(arrays)
    built_in = encoder is None and scorer is None
    if encoder is None:
        found = lambda **kw: sentence_links(arrays, t, block_rows=settings.token_block_rows, **kw)
        cand = pairs_of(found())
    else:
        vectors = encode_with(sents, encoder, batch_size=settings.batch_size)
        cand = dense_candidates(vectors, t, group="doc_id", ident="idx", vector="embedding", block_rows=settings.dense_block_rows)
    if built_in:
        scored = pairs_of(lexical_scorer(found(), settings.scorer_weights))
    else:
        texts = reports.with_texts(cand, docs)
        if scorer is None:
            scored = lexical_scorer(aligned_features(texts.drop("jac", "neg")), settings.scorer_weights)
        else:
            scored = model_scored(texts, scorer, settings)
        scored = scored.drop("sentence1", "sentence2")
    links = lexical_scorer(found(with_pairs=False), settings.scorer_weights) if built_in else None
    return DocumentCheck(docs, arrays, sents, cand, scored, settings, links, t)
