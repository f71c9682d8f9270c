"""The public jobs: capture, search, reports, chats and usage."""
