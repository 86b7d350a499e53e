"""cellar: table exploration, profiling, spreadsheet analytics and document
mining as Spark DataFrame operators."""

__version__ = "0.1.0"
