"""Daily moisture codes and rain as streams."""
