"""Writers. None of them overwrites a path that is being read."""
