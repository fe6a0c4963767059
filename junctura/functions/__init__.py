"""Column functions: sequences, CIGAR strings, alignment flags. All run in the JVM, none is a UDF."""
