"""Readers of peptide tables, provenance, designs, FASTA files and bundles."""
