"""PySpark operators for corpora of notebooks, documents, pages, dialogues and knowledge graphs."""
