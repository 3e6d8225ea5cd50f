"""Locus analytics on Spark: association results, gene models, genotypes, linkage disequilibrium."""
