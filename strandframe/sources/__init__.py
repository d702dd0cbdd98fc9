"""Readers of FASTA and FASTQ, and writers of the engine's own formats."""
