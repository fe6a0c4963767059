"""Readers and writers: FASTA, FASTQ, GTF, SAM, PSL, BED, homolog lists, labelled and known junctions, predictions.

Each format has a parser over a column of lines, and a reader that gives the parser what Spark reads from a path.
"""
