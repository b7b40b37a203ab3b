"""gridwarden: incident-feed analytics as Spark DataFrame transformations."""
