"""quillspark: document retrieval, cited answers and corpus preparation as Spark plans."""
