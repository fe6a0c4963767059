"""python -m junctura --anchor CDS.fasta --reads FOLDER --genome GENOME.fa --annotation GENES.gtf --out FOLDER

Reads are pairs of FASTQ files; each pair is a sample. For each anchored gene the predictions of all samples, and their
sums over samples, are written as tab-separated tables.
"""

from __future__ import annotations

import argparse
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.operators.exons import LOCI, exon_model
from junctura.operators.intervals import chunked
from junctura.plans import fusion, training
from junctura.session import session, ship
from junctura.sources import predictions, sequences, tables


def arguments() -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="junctura", description=__doc__)
    for name, text in (("anchor", "FASTA of the anchored genes' transcripts"), ("reads", "folder of <sample>_1/_2 FASTQ files"), ("genome", "FASTA"), ("annotation", "GTF"), ("out", "folder of the results")):
        p.add_argument(f"--{name}", required=True, help=text)
    p.add_argument("--names", help="file of the anchored genes to look at, one a line")
    p.add_argument("--positives", help="labelled sequences of natural junctions; with --alignments a filter is trained")
    p.add_argument("--alignments", help="SAM files of the reads in the genome, with SA tags")
    p.add_argument("--homologs", help="gene, tab, homologs with semicolons")
    p.add_argument("--model", help="folder of a filter to use, or to save the trained one in")
    p.add_argument("--no-filter", action="store_true", help="no scores")
    p.add_argument("--no-train", action="store_true", help="use the filter in --model as it is")
    p.add_argument("--seed-letters", type=int, default=fusion.Settings.k)
    return p.parse_args()


def main() -> None:
    from pyspark.ml.classification import LogisticRegressionModel

    a = arguments()
    spark = session()
    ship(spark)
    settings = fusion.Settings(k=a.seed_letters)
    genome = sequences.read_fasta(spark, a.genome).select(F.col("name").alias("chrom"), "seq")
    lines = spark.read.text(a.annotation)
    present = genome.select("chrom").distinct()
    loci = tuple(x for x in LOCI if x[0] in {r.chrom for r in present.where(F.col("chrom").isin([x[0] for x in LOCI])).collect()})
    of = lambda *paths, settings=None: predictions.digest(spark, [p for p in paths if p], settings)
    exons = predictions.stage(spark, lambda: exon_model(tables.real_genes(tables.parse_gtf(lines)), loci), f"{a.out}/exons", of(a.annotation, a.genome))
    genes = tables.parse_gtf(lines, "gene")
    chunks = chunked(genome)
    anchors = sequences.anchors(sequences.read_fasta(spark, a.anchor), spark.read.text(a.names) if a.names else None)
    names = [r.anchored_gene for r in anchors.select("anchored_gene").distinct().collect()]  # a handful by nature

    @cache
    def filter_model():
        """The filter, trained or loaded when the first gene asks for it; None for no scores."""
        if a.no_filter or not a.model and not (a.positives and a.alignments):
            return None
        if a.no_train or not (a.positives and a.alignments):
            return LogisticRegressionModel.load(a.model) if a.model and a.no_train else None
        edges = tables.read(spark, a.homologs, tables.parse_homologs) if a.homologs else spark.createDataFrame([], "gene string, homolog string")
        make = lambda: training.negative_sequences(tables.read_sam(spark, a.alignments), genome, chunks, exons, names, edges)
        negative = predictions.stage(spark, make, f"{a.out}/negatives", of(a.alignments, a.genome, a.annotation, a.homologs, settings=names))
        model, quality = training.train_filter(tables.read(spark, a.positives, tables.parse_labelled), negative)
        quality.write.mode("overwrite").json(f"{a.out}/filter")
        if a.model:
            model.write().overwrite().save(a.model)
        return model

    def predict(anchor: DataFrame) -> tuple[DataFrame, DataFrame]:
        model = filter_model()
        return fusion.predict(reads(), anchor, genome, exons, genes, settings, training.scorer(model, anchor, exons, chunks) if model else None)

    def files() -> list[str]:
        pairs = sequences.find_fastq_pairs(spark, a.reads)
        return [r.path for r in pairs.select(F.explode(F.array("first", "second")).alias("path")).collect()]

    @cache
    def reads() -> DataFrame:
        return predictions.stage(spark, lambda: sequences.read_fastq(spark, files()).drop("qual"), f"{a.out}/reads", of(a.reads))

    inputs = of(a.reads, a.genome, a.annotation, a.anchor, a.positives, a.alignments, a.homologs, a.no_train and a.model, settings=(settings, a.no_filter, a.no_train, a.model))
    for name in names:
        at = f"{a.out}/{name}"
        anchor = anchors.where(F.col("anchored_gene") == name)
        abridged, full = predictions.stages(spark, lambda anchor=anchor: predict(anchor), f"{at}/predictions", inputs, ("abridged", "full"))
        predictions.write_tsv(abridged, f"{at}/predictions_abridged", "overwrite")
        predictions.write_tsv(full, f"{at}/predictions_full", "overwrite")
        predictions.write_tsv(fusion.over_cells(abridged), f"{at}/over_cells", "overwrite")
    spark.stop()


if __name__ == "__main__":
    main()
