"""Training-data operators: ten jobs over tables of documents, pages and benchmark items."""
