"""Sources: files, HTML, configuration, artefacts written earlier, and corpora derived from tables."""
