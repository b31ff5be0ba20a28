"""kinloom: identity resolution over noisy multilocus genotypes, and corpus operators, as Spark jobs."""
