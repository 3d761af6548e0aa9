"""Event detection over multichannel sensor recordings, as Spark DataFrame operators."""
