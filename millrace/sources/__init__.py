"""Text inputs and their parsers, bulk loading, and tables written in shared folders."""
