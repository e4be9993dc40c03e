"""quern: an analytics and corpus-processing library written for PySpark."""
