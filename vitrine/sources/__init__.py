"""Sources: JSON feeds, driver-table bindings and table maintenance IO."""
