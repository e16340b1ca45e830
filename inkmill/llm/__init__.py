"""Training-data operators: ten Spark jobs over documents, vectors, pages and chats."""
