"""DataFrame to DataFrame operators over corpora."""
