"""Views, quality reports, extraction jobs and registry pipelines composed from the operators."""
