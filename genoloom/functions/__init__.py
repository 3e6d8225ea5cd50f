"""Column functions: names, attributes, genotypes, alleles."""
