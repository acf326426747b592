"""casemill: document-grounded case decisions as Spark DataFrame jobs."""
