"""Fixed vocabularies, rule packs, KPI catalogs and the star-schema inputs."""
