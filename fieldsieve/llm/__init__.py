"""Operations of a training-data pipeline, each on its own. Nothing else in the library imports this."""
