"""rillstone: transactional stream analytics expressed as Spark plans."""
