"""Column functions over fields, alleles and genotypes; built-in expressions only."""
