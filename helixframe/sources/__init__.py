"""Sources and sinks: plain, gzip and block-gzip VCF, indexes, the ``vcf`` data source."""
