"""DataFrame to DataFrame operators; none runs an action unless it says so."""
