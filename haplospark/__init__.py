"""Population-genomic statistics over haploid aligned sequences, as PySpark DataFrame jobs."""
