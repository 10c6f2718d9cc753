"""Sources: texts, dataset shapes and the test bed."""
